"""Queries on the graph, resolution, snapshots and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions.classify import generic_layer
from evigraph.operators import export, graph, resolve
from evigraph.plans.common import literal_rows, query, values_sql
from evigraph.sources import store
from evigraph.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table

GRAPH = f"{NODES_SQL}, {EDGES_SQL}"
SEEDS = [("nation::3",), ("customer::7",)]
SEED_SQL = values_sql(SEEDS, "seeds", "node_id")
BOTH = "both_ways as (select relation, source_id, target_id, source_id as a, target_id as b from edges union all select relation, source_id, target_id, target_id, source_id from edges)"


def seeds(spark):
    return literal_rows(spark, SEEDS, "node_id string")


@query(f"""with {GRAPH}, {SEED_SQL}, {BOTH},
h1 as (select b as node_id, min((relation, source_id, target_id)) as by_edge from both_ways where a in (select node_id from seeds) and b not in (select node_id from seeds) group by b),
d1 as (select node_id, 1 as distance, (by_edge)[1] as relation from (select *, row_number() over (order by by_edge, node_id) as n from h1) where n <= 200),
h2 as (select b as node_id, min((relation, source_id, target_id)) as by_edge from both_ways where a in (select node_id from d1) and b not in (select node_id from d1) and b not in (select node_id from seeds) group by b),
d2 as (select node_id, 2 as distance, (by_edge)[1] as relation from (select *, row_number() over (order by by_edge, node_id) as n from h2) where n <= 200 - (select count(*) from d1))
select * from d1 union all select * from d2""")
def graph_walk_depth2(spark, d):
    return graph.graph_walk(edges(spark, d), seeds(spark), None, 2, 200)


@query(f"""with {GRAPH}, {BOTH}, s as (select 'nation::' || n_nationkey as start_id from nation), e as (select distinct a, b from both_ways),
d1 as (select distinct start_id, b as node_id from s join e on a = start_id), d2 as (select distinct start_id, e.b as node_id from d1 join e on e.a = d1.node_id)
select start_id, node_id, 1 as distance from d1 union all select start_id, node_id, 2 from d2 where node_id <> start_id and (start_id, node_id) not in (select start_id, node_id from d1)""")
def graph_reach_batch(spark, d):
    return graph.reach(edges(spark, d), table(spark, d, "nation").select(F.concat(F.lit("nation::"), F.col("n_nationkey").cast("string")).alias("node_id")))


@query(f"""with {GRAPH}, {SEED_SQL}, e as (select * from edges where source_id in (select node_id from seeds) or target_id in (select node_id from seeds)),
f as (select * from e order by confidence desc, relation, source_id, target_id, evidence_path, start_line limit 50)
select f.*, s.name as source_name, t.name as target_name from f join nodes s on s.node_id = source_id join nodes t on t.node_id = target_id""")
def graph_neighbors(spark, d):
    return graph.neighbors(nodes(spark, d), edges(spark, d), seeds(spark))


@query(f"""with {GRAPH}, {SEED_SQL}, e as (select * from edges where source_id in (select node_id from seeds) or target_id in (select node_id from seeds)),
l as (select s.name || ' --' || relation || '--> ' || t.name as line, max(confidence) as c from e join nodes s on s.node_id = source_id join nodes t on t.node_id = target_id group by s.name, relation, t.name) select line from l order by c desc, line limit 24""")
def architecture_lines(spark, d):
    return graph.architecture_lines(nodes(spark, d), edges(spark, d), seeds(spark))


DEGREE = f"{GRAPH}, ends as (select source_id as node_id from edges union all select target_id from edges), deg as (select node_id, count(*) as degree from ends group by node_id), top as (select n.node_id, kind, name, coalesce(degree, 0) as degree from nodes n left join deg using (node_id) order by degree desc, qualified_name, n.node_id limit 48)"


@query(f"with {DEGREE} select * from top")
def degree_topk(spark, d):
    return graph.overview(nodes(spark, d), edges(spark, d))


@query(f"with {GRAPH}, few as (select node_id from nodes where kind in ('region', 'nation', 'supplier')) select source_id, relation, target_id, evidence_path, round(confidence, 3) as confidence from edges where source_id in (select node_id from few) and target_id in (select node_id from few) order by edges.confidence desc, source_id, relation, target_id limit 192")
def induced_subgraph(spark, d):
    return graph.induced(edges(spark, d), nodes(spark, d).filter("kind in ('region', 'nation', 'supplier')"), 192)


@query(f"""with {GRAPH}, {SEED_SQL}, {BOTH}, a as (select node_id, 0 as distance from seeds union all select b, 1 from both_ways where a in (select node_id from seeds)), m as (select node_id, min(distance) as distance from a group by node_id)
select node_id, kind, name, distance from m join nodes using (node_id) order by distance, node_id limit 64""")
def ego_graph(spark, d):
    return graph.ego(nodes(spark, d), edges(spark, d), seeds(spark))


@query(f"with {GRAPH}, x as (select node_id, case when kind in ('customer', 'part') then 'external_symbol' else kind end as kind from nodes), called as (select * from edges where relation = 'CALLS') select node_id from x where kind = 'external_symbol' and not exists (select 1 from called where source_id = node_id) and not exists (select 1 from called where target_id = node_id)")
def orphan_nodes(spark, d):
    """Of customers and parts, taken as external symbols, those without a call."""
    n = nodes(spark, d).withColumn("kind", F.when(F.col("kind").isin("customer", "part"), "external_symbol").otherwise(F.col("kind")))
    return graph.orphans(n, edges(spark, d).filter("relation = 'CALLS'")).select("node_id")


@query(f"""with {GRAPH}, x as (select e.*, '@derived:' || evidence_path || '/' || start_line % 10 as owner from edges e where relation = 'CALLS')
select distinct owner as evidence_path from x where source_id in (select node_id from nodes where path in ('customer/5', 'customer/9')) or target_id in (select node_id from nodes where path in ('customer/5', 'customer/9'))""")
def owners_touching(spark, d):
    e = edges(spark, d).filter("relation = 'CALLS'").withColumn("evidence_path", F.concat(F.lit("@derived:"), "evidence_path", F.lit("/"), (F.col("start_line") % 10).cast("string")))
    return graph.owners_touching(e, nodes(spark, d), literal_rows(spark, [("customer/5",), ("customer/9",)], "path string"))


# References by name: each customer refers to its nation by qualified name, each part to itself by simple name.
REFS = f"""{NODES_SQL}, refs as (select 'c' || c_custkey as ref, 'DEPENDS_ON' as relation, r_name || '.' || n_name as qualified_name from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey
union all select 'p' || p_partkey, 'DEPENDS_ON', 'x.' || p_name from part union all select 's' || s_suppkey, 'EXTENDS', 'Unknown.' || s_name from supplier)"""


def references(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    a = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ref"), F.lit("DEPENDS_ON").alias("relation"), F.concat("r_name", F.lit("."), "n_name").alias("qualified_name"))
    b = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.lit("DEPENDS_ON"), F.concat(F.lit("x."), "p_name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("EXTENDS"), F.concat(F.lit("Unknown."), "s_name"))
    return a.union(b).union(s)


RESOLVED = f"""{REFS}, q as (select lower(qualified_name) as k, min(node_id) as node_id from nodes group by 1 having count(*) = 1), n as (select lower(name) as k, min(node_id) as node_id from nodes group by 1 having count(*) = 1),
res as (select ref, coalesce(q.node_id, n.node_id) as node_id, case when q.node_id is not null then 'qualified' else 'simple' end as strategy from refs left join q on q.k = lower(qualified_name) left join n on n.k = regexp_replace(split_part(lower(qualified_name), '#', 1), '^.*\\.', '') where coalesce(q.node_id, n.node_id) is not null)"""


@query(f"with {RESOLVED} select * from res")
def resolve_cascade(spark, d):
    return resolve.resolve(references(spark, d), nodes(spark, d))


@query(f"with {NODES_SQL} select name, min(node_id) as node_id from nodes group by name having count(distinct node_id) = 1")
def resolve_unique(spark, d):
    return resolve.unique(nodes(spark, d), "name").select("name", "node_id")


ENDPOINTS = [("e1", "endpoint", "GET /users/{}"), ("e2", "endpoint", "GET /users/me"), ("e3", "endpoint", "ANY /health"), ("e4", "endpoint", "POST /orders/{}/items"), ("e5", "endpoint", "GET /teams/{}/x")]
CALLS = [("r1", "CALLS_ENDPOINT", "GET /users/42"), ("r2", "CALLS_ENDPOINT", "GET /health"), ("r3", "CALLS_ENDPOINT", "POST /orders/7/items"), ("r4", "CALLS_ENDPOINT", "GET /users/me"), ("r5", "CALLS_ENDPOINT", "GET /teams/a/b"), ("r6", "CALLS_ENDPOINT", "DELETE /users/42")]


@query("with " + values_sql(ENDPOINTS, "n", "node_id, kind, qn") + ", " + values_sql(CALLS, "r", "ref, relation, qn") + r""", p as (select node_id, lower(split_part(qn, ' ', 1)) as m, string_split(lower(split_part(qn, ' ', 2)), '/') as s from n), c as (select ref, lower(split_part(qn, ' ', 1)) as m, string_split(lower(split_part(qn, ' ', 2)), '/') as s from r),
m as (select ref, node_id from c join p on c.m = p.m and len(c.s) = len(p.s) and list_bool_and(list_transform(range(1, len(c.s) + 1), lambda i: p.s[i] = '{}' or p.s[i] = c.s[i]))), u as (select ref, min(node_id) as node_id from m group by ref having count(*) = 1) select r.ref, coalesce(n.node_id, u.node_id) as node_id from r left join n on n.qn = r.qn left join u on u.ref = r.ref where coalesce(n.node_id, u.node_id) is not null""")
def contract_match(spark, d):
    n = literal_rows(spark, ENDPOINTS, "node_id string, kind string, qualified_name string").withColumn("name", F.col("qualified_name"))
    return resolve.resolve(literal_rows(spark, CALLS, "ref string, relation string, qualified_name string"), n).select("ref", "node_id")


@query(f"""with {GRAPH}, ext as (select 'external::' || p_partkey as node_id, p_name as name, p_brand || '.' || p_name as qualified_name from part),
e as (select source_id, 'DEPENDS_ON' as relation, 'external::' || l_partkey as target_id from (select 'order::' || l_orderkey as source_id, l_partkey from lineitem)),
r as (select distinct source_id, relation, qualified_name from e join ext on ext.node_id = e.target_id), q as (select lower(qualified_name) as k, min(node_id) as node_id from nodes group by 1 having count(*) = 1),
n as (select lower(name) as k, min(node_id) as node_id from nodes group by 1 having count(*) = 1),
x as (select source_id, coalesce(q.node_id, n.node_id) as target_id, qualified_name from r left join q on q.k = lower(qualified_name) left join n on n.k = regexp_replace(lower(qualified_name), '^.*\\.', ''))
select distinct x.source_id, 'RESOLVED_DEPENDS_ON' as relation, target_id, '@derived:' || s.path as evidence_path, case when contains(x.qualified_name, '.') then 0.92::double else 0.78::double end as confidence from x join nodes s on s.node_id = x.source_id where target_id is not null and target_id <> x.source_id""")
def derived_edges(spark, d):
    ext = table(spark, d, "part").select(F.concat(F.lit("external::"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("external_symbol").alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.lit(None).cast("string").alias("path"))
    e = table(spark, d, "lineitem").select(F.concat(F.lit("order::"), F.col("l_orderkey").cast("string")).alias("source_id"), F.lit("DEPENDS_ON").alias("relation"), F.concat(F.lit("external::"), F.col("l_partkey").cast("string")).alias("target_id"))
    return resolve.derived_edges(e, nodes(spark, d).union(ext))


@query("""with n as (select c_custkey as id, case when c_custkey % 2 = 0 then 'Client' || c_custkey // 2 else 'Client' || c_custkey // 2 || 'Test' end as name, c_custkey % 2 = 1 as t from customer)
select 'n' || a.id as source_id, 'TESTS' as relation, 'n' || b.id as target_id, 0.9::double as confidence from n a join n b on a.t and not b.t and lower(b.name) = lower(left(a.name, length(a.name) - 4))""")
def tests_link(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Client"), F.floor(k / 2).cast("string"), F.when(k % 2 == 1, "Test").otherwise(""))
    n = table(spark, d, "customer").select(F.concat(F.lit("n"), k.cast("string")).alias("node_id"), name.alias("name")).withColumn("layer", generic_layer(F.col("name"), F.lit("")))
    return resolve.test_links(n)


@query(f"""with {EDGES_SQL}, p as (select distinct a.source_id as controller, a.target_id as service, b.target_id as repository from edges a join edges b on a.target_id = b.source_id where a.source_id like 'customer::%' and a.target_id like 'order::%' and b.target_id like 'part::%'),
r as (select *, row_number() over (partition by controller order by service, repository) as n from p) select controller, service, repository from r where n = 1""")
def layered_pattern(spark, d):
    layers = nodes(spark, d).select("node_id", F.when(F.col("kind") == "customer", "controller").when(F.col("kind") == "order", "service").when(F.col("kind") == "part", "repository").otherwise("domain").alias("layer"))
    return resolve.layered(edges(spark, d), layers)


@query(f"""with {GRAPH}, ext as (select node_id, name, qualified_name from nodes where kind = 'part'), hit as (select node_id from ext where name = 'red widget' or lower(qualified_name) = 'brand#2.small ring')
select distinct s.path from edges e join nodes s on s.node_id = e.source_id where e.target_id in (select node_id from hit)""")
def reference_owners(spark, d):
    n = nodes(spark, d).withColumn("kind", F.when(F.col("kind") == "part", "external_symbol").otherwise(F.col("kind")))
    return resolve.reference_owners(edges(spark, d), n, literal_rows(spark, [("red widget", "none"), ("none", "Brand#2.small ring")], "name string, qualified_name string"))


@query("""with a as (select source || '/' || doc_id as path, n_chars as size, doc_id % 3 as mtime from documents where doc_id % 10 <> 1), b as (select source || '/' || doc_id as path, n_chars + (doc_id % 7 = 0)::int as size, doc_id % 3 as mtime from documents where doc_id % 10 <> 2)
select path, case when a.path is null then 'added' when b.path is null then 'deleted' else 'modified' end as change from a full join b using (path) where a.path is null or b.path is null or a.size <> b.size or a.mtime <> b.mtime""")
def snapshot_diff(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 3).alias("mtime"))
    return store.snapshot_diff(t.filter("doc_id % 10 <> 1"), t.filter("doc_id % 10 <> 2").withColumn("size", F.col("size") + (F.col("doc_id") % 7 == 0).cast("int")))


@query("""select 'order::' || o_orderkey as node_id, case when o_orderkey % 2 = 0 then 'new' else 'old' end as kind, case when o_orderkey % 4 = 0 then 'new/' || o_orderkey else 'old/' || o_orderkey end as path, (case when o_orderkey % 6 = 0 then 9 else 1 end)::int as start_line, (case when o_orderkey % 6 = 0 then 19 else 5 end)::int as end_line from orders""")
def node_upsert_merge(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order::"), F.col("o_orderkey").cast("string")).alias("node_id"))
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    old = o.select("node_id", F.lit("old").alias("kind"), F.concat(F.lit("old/"), s).alias("path"), F.lit(1).alias("start_line"), F.lit(5).alias("end_line"))
    new = o.filter(k % 2 == 0).select("node_id", F.lit("new").alias("kind"), F.when(k % 4 == 0, F.concat(F.lit("new/"), s)).alias("path"), F.when(k % 6 == 0, 9).otherwise(0).alias("start_line"), F.when(k % 6 == 0, 19).otherwise(-1).alias("end_line"), k.alias("seq"))
    return store.merge_nodes(old, new)


@query(f"with {EDGES_SQL} select source_id, relation, target_id, evidence_path, start_line, end_line, case when relation = 'CONTAINS' then 0.5 else confidence end as confidence from edges")
def edge_upsert_dedup(spark, d):
    e = edges(spark, d)
    again = e.filter("relation = 'CONTAINS'").withColumn("seq", F.lit(1).cast("long"))
    return store.merge_edges(e, again.unionByName(again.withColumn("confidence", F.lit(0.5)).withColumn("seq", F.lit(2).cast("long"))))


GONE = [("customer/5",), ("customer/9",), ("part/3",)]


@query(f"with {GRAPH}, kept as (select node_id from nodes where path not in ('customer/5', 'customer/9', 'part/3')) select relation, count(*) as n from edges where source_id in (select node_id from kept) and target_id in (select node_id from kept) group by relation")
def cascade_delete(spark, d):
    chunks = nodes(spark, d).select("path", F.col("node_id").alias("symbol_id"))
    _, left, _ = store.delete_paths(nodes(spark, d), edges(spark, d), chunks, literal_rows(spark, GONE, "path string"))
    return left.groupBy("relation").agg(F.count("*").alias("n"))


@query(f"with {GRAPH} select e.source_id, e.relation, e.target_id from edges e where e.target_id not in (select node_id from nodes where kind <> 'part' or node_id not like '%7')")
def dangling_edges(spark, d):
    n = nodes(spark, d).filter("kind <> 'part' or node_id not like '%7'")
    return store.dangling(edges(spark, d), n).select("source_id", "relation", "target_id")


@query(f"""with {GRAPH}, v as (select node_id, qualified_name, 'n' || row_number() over (order by node_id) as alias from nodes where kind in ('region', 'nation')),
l as (select 0 as part, '' as a, '' as b, 'graph LR' as line union all select 1, node_id, '', '    ' || alias || '["' || left(replace(qualified_name, '"', ''''), 100) || '"]' from v
union all select 2, source_id || chr(31) || target_id, relation, '    ' || s.alias || ' -->|' || relation || '| ' || t.alias from edges join v s on s.node_id = source_id join v t on t.node_id = target_id)
select (row_number() over (order by part, a, b, line))::int as line_no, line from l""")
def export_mermaid(spark, d):
    return export.mermaid(nodes(spark, d).filter("kind in ('region', 'nation')"), edges(spark, d))
