"""Queries on lookup, full-text ranking, fusion and packing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.scores import bm25_norm, graph_score, lexical, noisy_or, overlap_ratio
from evigraph.functions.text import MARKED, PLAIN, casefold
from evigraph.operators import chunking, fusion, lookup, packing, search
from evigraph.plans.common import literal_rows, query, values_sql
from evigraph.sources.tables import FILES_SQL, NODES_SQL, files, nodes, table

TERMS = [(0, "NATION_3"), (1, "Customer#00000001"), (2, "red widget"), (3, "Brand#1"), (4, "orders/12"), (5, "  "), (6, "asia")]
NORMAL = "trim(replace(replace(lower({}), 'ß', 'ss'), '\\', '/'))"

LOOKUP = f"""{NODES_SQL}, {values_sql(TERMS, "terms", "term_index, term")}, t as (select term_index, {NORMAL.format("term")} as t from terms where {NORMAL.format("term")} <> ''),
n as (select node_id, kind, qualified_name, {NORMAL.format("name")} as n, {NORMAL.format("qualified_name")} as q, {NORMAL.format("path")} as p from nodes),
h as (select term_index, node_id, kind, qualified_name, case when n = t or q = t then 1.0 when starts_with(n, t) then 0.85 when starts_with(q, t) then 0.80 when starts_with(p, t) then 0.72 end::double as score from n, t),
r as (select *, row_number() over (partition by term_index order by score desc, qualified_name, node_id) as rank from h where score is not null),
k as (select * from r where rank <= 20),
b as (select node_id, qualified_name, max(score) as score, arg_min(term_index, term_index * 1000 + rank) as ti, arg_min(rank, term_index * 1000 + rank) as rk from k group by node_id, qualified_name),
best as (select node_id, qualified_name, score from b order by score desc, ti, rk, node_id limit 20)"""


def terms(spark):
    return literal_rows(spark, TERMS, "term_index int, term string")


@query(f"with {LOOKUP} select term_index, node_id, qualified_name, score, rank::int as rank from k")
def exact_lookup(spark, d):
    return lookup.term_hits(nodes(spark, d), terms(spark))


@query(f"with {LOOKUP} select * from best")
def exact_multi_term_topk(spark, d):
    return lookup.exact_nodes(nodes(spark, d), terms(spark))


@query(f"with {LOOKUP}, w as (select b.node_id, b.score, n.kind from best b join nodes n on n.node_id = b.node_id) select * from w where kind in ('nation', 'region') or not exists (select 1 from w where kind in ('nation', 'region'))")
def kind_preference_fallback(spark, d):
    hits = lookup.exact_nodes(nodes(spark, d), terms(spark)).select("node_id", "score").join(nodes(spark, d).select("node_id", "kind"), "node_id")
    return lookup.preferred(hits, ["nation", "region"])


@query(f"with {NODES_SQL} select node_id, name from nodes where starts_with({NORMAL.format('name')}, 'customer#00000003') order by {NORMAL.format('name')}, node_id limit 20")
def prefix_topk(spark, d):
    return lookup.prefix_search(nodes(spark, d), "Customer#00000003")


TASKS = [("q1", "the erthat onthese with"), ("q2", "License Version 2.0 Apache"), ("q3", "der nicht und heit"), ("q4", "token password contact example.com")]
FOLDED = f"translate(lower({{}}), '{MARKED}', '{PLAIN}')"


def bm25_sql(docs: str, columns: dict[str, float], queries: list[tuple], prefix: bool = False, limit: int = 20) -> str:
    """docs: a common table expression docs with the key doc and those columns."""
    cols = " union all ".join(f"select doc, '{c}' as col, {w}::double as weight, {FOLDED.format(f'coalesce({c}::varchar, {chr(39) * 2})')} as x from docs" for c, w in columns.items())
    match = "p.tok = w.tok or (w.k = w.size - 1 and starts_with(p.tok, w.tok))" if prefix else "p.tok = w.tok"
    return f"""with {docs}, {values_sql(queries, "queries", "query, text")}, cols as ({cols}),
toks as (select doc, col, weight, regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+') as a from cols),
post as (select doc, col, weight, unnest(a) as tok, unnest(range(len(a))) as pos from toks),
len as (select doc, sum(len(a)) as dl from toks group by doc), corpus as (select count(*) as docs, avg(dl) as avgdl from len),
qt as (select query, list_filter(regexp_extract_all({CF.format("text")}, '[\\p{{L}}\\p{{N}}_.\\-]+'), lambda x: length(x) > 1) as ts from queries),
qu as (select query, unnest(ts) as token, unnest(range(len(ts))) as i from qt), qd as (select query, token, min(i) as i from qu group by query, token),
qp as (select query, i, regexp_extract_all({FOLDED.format("token")}, '[\\p{{L}}\\p{{N}}]+') as ws from (select *, row_number() over (partition by query order by i) as n from qd) where n <= 20),
wanted as (select query, i as phrase, len(ws) as size, unnest(ws) as tok, unnest(range(len(ws))) as k from qp),
hits as (select w.query, w.phrase, w.size, p.doc, p.col, any_value(p.weight) as weight, p.pos - w.k as at, count(distinct w.k) as n from post p join wanted w on {match} group by w.query, w.phrase, w.size, p.doc, p.col, p.pos - w.k),
tf as (select query, phrase, doc, sum(weight) as f from hits where n = size group by query, phrase, doc), df as (select query, phrase, count(*) as n from tf group by query, phrase),
s as (select tf.query, tf.doc, sum(case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) as raw from tf join df using (query, phrase) join len on len.doc = tf.doc, corpus group by tf.query, tf.doc),
ranked as (select query, doc, round(raw, 6) as score, row_number() over (partition by query order by round(raw, 6) desc, doc) as rank from s)
select query, doc, score, rank::int as rank, round(least(0.88, 0.35 + 0.35 / sqrt(rank) + 0.25 * (score / (1 + score))), 6) as lexical from ranked where rank <= {limit}"""


CF = "replace(lower({}), 'ß', 'ss')"


def tasks(spark, rows=None):
    return literal_rows(spark, rows or TASKS, "query string, text string")


def chunk_rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("path"), F.col("lang").alias("tags"), F.col("text").alias("content"))


DOCS = "docs as (select doc_id as doc, source as path, lang as tags, text as content from documents)"


@query(bm25_sql(DOCS, {"content": 1.0}, TASKS))
def bm25_chunks(spark, d):
    return search.search(chunk_rows(spark, d), "doc", {"content": 1.0}, tasks(spark))


WEIGHTS = {"path": 1.8, "tags": 0.5, "content": 1.0}
FIELD_TASKS = [("f1", "src3 erthat fr"), ("f2", "de heit src19")]


@query(bm25_sql(DOCS, WEIGHTS, FIELD_TASKS))
def bm25_weighted_fields(spark, d):
    return search.search(chunk_rows(spark, d), "doc", WEIGHTS, tasks(spark, FIELD_TASKS))


PHRASE_TASKS = [("p1", "apache-license of.the"), ("p2", "in_the"), ("p3", "version.2.0")]


@query(bm25_sql(DOCS, {"content": 1.0}, PHRASE_TASKS))
def bm25_phrase(spark, d):
    return search.search(chunk_rows(spark, d), "doc", {"content": 1.0}, tasks(spark, PHRASE_TASKS))


NODE_WEIGHTS = {"name": 2.0, "qualified_name": 1.5, "path": 0.8, "kind": 0.4}
NODE_TASKS = [("n1", "widg nation_2"), ("n2", "Customer#0000001"), ("n3", "Brand#2 bol")]


@query(bm25_sql(f"{NODES_SQL}, docs as (select node_id as doc, * from nodes)", NODE_WEIGHTS, NODE_TASKS, prefix=True))
def bm25_prefix(spark, d):
    return search.search(nodes(spark, d).withColumnRenamed("node_id", "doc"), "doc", NODE_WEIGHTS, tasks(spark, NODE_TASKS), prefix=True)


@query("""select doc_id, round(least(0.88, 0.35 + 0.35 / sqrt(doc_id + 1) + 0.25 * (n_chars / (1.0::double + n_chars))), 6) as lexical, round(0.6 + 0.1 * (n_chars / (1.0::double + n_chars)), 6) as node from documents""")
def lexical_score(spark, d):
    norm = bm25_norm(F.col("n_chars").cast("double"))
    return table(spark, d, "documents").select("doc_id", F.round(lexical(F.col("doc_id") + 1, norm), 6).alias("lexical"), F.round(search.node_score(norm), 6).alias("node"))


SPLIT = "string_split(regexp_replace(content, '\\n\\z', ''), chr(10))"
WINDOWS = f"""{FILES_SQL}, l as (select path, language, {SPLIT} as a from files where content <> ''),
w as (select path, language, a, unnest(range(0, greatest(0, ceil((len(a) - 20) / 17.0))::bigint + 1)) * 17 + 1 as s from l),
windows as (select path, language, s::int as start_line, least(s + 19, len(a))::int as end_line, array_to_string(list_slice(a, s, s + 19), chr(10)) as content from w)"""


@query(f"with {WINDOWS} select path, language, start_line, end_line, md5(content) as digest from windows")
def line_window_chunks(spark, d):
    return chunking.line_windows(files(spark, d), 20, 3).select("path", "language", "start_line", "end_line", F.md5("content").alias("digest"))


@query(f"""with {WINDOWS}, e as (select path, start_line, unnest(range(start_line, end_line + 1)) as line from windows),
f as (select e.* from e join files on files.path = e.path where not (line between 3 and 9 or line between 25 and 30)) select distinct path, min(line)::int as start_line, max(line)::int as end_line from f group by path, f.start_line""")
def uncovered_windows(spark, d):
    f = files(spark, d)
    covered = f.select("path", F.explode(F.array(F.struct(F.lit(3).alias("start_line"), F.lit(9).alias("end_line")), F.struct(F.lit(25).alias("start_line"), F.lit(30).alias("end_line")))).alias("r")).select("path", "r.*")
    return chunking.uncovered_windows(f, covered, 20, 3).select("path", "start_line", "end_line")


HEADED = "case when doc_id % 2 = 0 then regexp_replace(text, '(?m)^(\\p{Lu})', '# \\1', 'g') else text end"


@query(f"""with h as (select source || '/' || doc_id as path, {HEADED} as content from documents where coalesce(text, '') <> ''), l as (select path, {SPLIT} as a from h),
e as (select path, unnest(a) as t, unnest(range(len(a))) + 1 as line from l), m as (select *, regexp_matches(t, '^#{{1,6}}\\s+\\S') as head from e),
s as (select *, sum(head::int) over (partition by path order by line) as sec, max(head::int) over (partition by path) as any_head from m),
g as (select path, sec, min(line)::int as start_line, max(line)::int as end_line, max(case when head then t end) as heading from s where any_head = 0 or sec > 0 group by path, sec)
select path, start_line, end_line, array_to_string(list_concat(['markdown'], list_transform(list_slice(regexp_extract_all(lower(coalesce(heading, '')), '[a-z0-9]{{2,}}'), 1, 8), lambda w: 'section:' || w)), ',') as tags from g""")
def heading_sections(spark, d):
    t = table(spark, d, "documents").filter(F.coalesce("text", F.lit("")) != "")
    content = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"(?m)^(\p{Lu})", "# $1")).otherwise(F.col("text"))
    f = t.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), content.alias("content"))
    return chunking.heading_sections(f).select("path", "start_line", "end_line", F.array_join("tags", ",").alias("tags"))


# The hybrid query: three channels of candidates over documents, boosts, fusion, threshold, a cap for each path.
TASK = "erthat onthese with database endpoint"
HYBRID = [("h", TASK)]


def candidates(spark, d):
    docs = table(spark, d, "documents")
    ranked = search.search(chunk_rows(spark, d), "doc", {"content": 1.0}, tasks(spark, HYBRID), limit=60)
    none = F.lit(None).cast("int")
    words = ranked.select("doc", F.lit(1).alias("channel_order"), F.concat(F.lit("fts-rank-"), F.col("rank").cast("string")).alias("reason"), F.col("lexical").alias("score"), none.alias("distance"))
    keyed = docs.select(F.col("doc_id").alias("doc"), F.array("lang", "source").alias("tags"))
    exact = docs.filter(F.startswith(casefold(F.col("text")), F.lit("the and"))).select(F.col("doc_id").alias("doc"), F.lit(0), F.lit("exact-symbol"), F.lit(fusion.SAME_FILE), none)
    near = docs.filter("source = 'src7'").select(F.col("doc_id").alias("doc"), F.lit(2), F.lit("graph:CONTAINS"), graph_score(F.lit(2)), F.lit(2))
    base = words.union(exact).union(near)
    found = keyed.join(base.select("doc").distinct(), "doc", "left_semi")
    return base.union(fusion.tag_boosts(found, ["doc"], ["fr", "de"], fusion.TASK_TAG, "task-tag", 3)).union(fusion.tag_boosts(found, ["doc"], ["src1", "src2"], fusion.PERSONA_TAG, "persona-tag", 4))


CANDIDATES = bm25_sql(DOCS, {"content": 1.0}, HYBRID, limit=60).replace("select query, doc, score, rank::int", ", words as (select query, doc, score, rank::int", 1) + """),
exact as (select doc_id as doc from documents where starts_with(replace(lower(text), 'ß', 'ss'), 'the and')), near as (select doc_id as doc from documents where source = 'src7'),
base as (select doc, 1 as o, 'fts-rank-' || rank as reason, lexical as score, null::int as distance from words union all select doc, 0, 'exact-symbol', 0.72, null from exact union all select doc, 2, 'graph:CONTAINS', 0.32, 2 from near),
found as (select doc_id as doc, lang, source from documents where doc_id in (select doc from base)),
cand as (select * from base union all select doc, 3, 'task-tag:' || lang, 0.48, null from found where lang in ('fr', 'de') union all select doc, 4, 'persona-tag:' || source, 0.20, null from found where source in ('src1', 'src2')),
fused as (select doc, round(1 - product(1 - greatest(0, least(0.99, score))), 6) as score, string_agg(reason, ',' order by o, reason) as reasons, min(distance) as distance from cand group by doc)"""


def fused(spark, d):
    out = fusion.fuse(candidates(spark, d), ["doc"])
    return out.select("doc", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"), "distance")


@query(CANDIDATES + " select doc, score, reasons, distance from fused")
def noisy_or_fusion(spark, d):
    return fused(spark, d)


@query("select doc_id, round(1 - (1 - least(0.99, n_chars / 10000.0::double)) * (1 - 0.48) * (1 - 0.2), 6) as score from documents")
def noisy_or_columns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(noisy_or(F.array(F.col("n_chars") / 10000.0, F.lit(0.48), F.lit(0.2))), 6).alias("score"))


@query("select doc_id, 'task-tag:' || lang as reason, 0.48::double as score from documents where lang in ('fr', 'de')")
def tag_boost(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return fusion.tag_boosts(docs, ["doc_id"], ["fr", "de"], fusion.TASK_TAG, "task-tag", 0).select("doc_id", "reason", "score")


KEPT = CANDIDATES + ", kept as (select *, max(score) over () as top from fused), over_t as (select doc, score, reasons from kept where score >= greatest(0.05, least(0.45, 0.40 * top)))"


@query(KEPT + " select doc, score from over_t")
def dynamic_threshold(spark, d):
    return fusion.above_threshold(fused(spark, d)).select("doc", "score")


CAPPED = KEPT + ", ranked_h as (select o.doc, source as path, score, row_number() over (partition by source order by score desc, o.doc) as n from over_t o join documents on doc_id = o.doc)"


def by_path(spark, d, most):
    paths = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("path"))
    kept = fusion.above_threshold(fused(spark, d)).join(paths, "doc")
    return fusion.per_path(kept, most, [F.desc("score"), F.col("doc")])


@query(CAPPED + " select doc, path, score from ranked_h where n <= 3")
def per_file_cap(spark, d):
    return by_path(spark, d, 3).select("doc", "path", "score")


@query(CAPPED + " select doc, path, score from ranked_h where n = 1 order by score desc, doc limit 3")
def clarify_one_per_path(spark, d):
    return by_path(spark, d, 1).orderBy(F.desc("score"), "doc").limit(3).select("doc", "path", "score")


@query(CAPPED + " select doc, path, score from ranked_h where n <= 3 order by score desc, doc limit 20")
def hybrid_retrieval(spark, d):
    return by_path(spark, d, 3).orderBy(F.desc("score"), "doc").limit(20).select("doc", "path", "score")


ASKED = [("a1", "erthat onthese something"), ("a2", "fix PaymentService OrderRepository"), ("a3", "zzzz")]


@query(bm25_sql(DOCS, {"content": 1.0}, ASKED).replace("select query, doc, score, rank::int", ", r as (select query, doc, score, rank::int", 1) + """),
top as (select query, count(*) as hits, max(case when rank = 1 then lexical end) as s1, max(case when rank = 2 then lexical end) as s2 from r group by query),
t as (select query, text in ('erthat onthese something') as vague, text = 'zzzz' as few from queries),
j as (select t.query, vague, few, coalesce(hits, 0) as hits, coalesce(s1, 0) as s1, coalesce(hits, 0) >= 2 and coalesce(s1, 0) - coalesce(s2, 0) < 0.12 as competing from t left join top using (query))
select query, hits = 0 or s1 < 0.72 or competing or few or (vague and (competing or few)) as ambiguous,
  round(case when hits = 0 then 0 else least(1, greatest(0, s1 * 0.88 * case when competing then 0.75 else 1 end * case when vague then 0.85 else 1 end * case when few then 0.9 else 1 end)) end::double, 3) as confidence from j""")
def query_assessment(spark, d):
    ranked = search.search(chunk_rows(spark, d), "doc", {"content": 1.0}, tasks(spark, ASKED))
    ranked = ranked.select("query", "rank", F.col("lexical").alias("score"), F.array(F.lit("fts-rank")).alias("reasons"))
    return fusion.assess(ranked, tasks(spark, ASKED))


def ranked_chunks(spark, d):
    """Chunks of the documents of a source as the candidates of one query for each language."""
    w = chunking.line_windows(files(spark, d), 20, 3)
    scored = w.withColumn("score", F.round(F.length("content") / (F.length("content") + 500.0), 6))
    return scored.select(F.col("language").alias("query"), "path", "language", "start_line", "end_line", "content", "score", F.row_number().over(W.partitionBy("language").orderBy(F.desc("score"), "path", "start_line")).alias("rank"))


RANKED = f"""{WINDOWS}, sc as (select language as query, path, language, start_line, end_line, content, round(length(content) / (length(content) + 500.0::double), 6) as score from windows),
rk as (select *, row_number() over (partition by query order by score desc, path, start_line) as rank from sc)"""


@query(f"""with {RANKED}, c as (select *, greatest(1, ceil(strlen(content) / 3.6::double))::bigint + 25 as cost from rk), u as (select *, sum(cost) over (partition by query order by rank) as used from c)
select query, path, start_line, rank::int as rank, used::bigint as used from u where used <= 9000""")
def budget_prefix(spark, d):
    return packing.budget_prefix(ranked_chunks(spark, d), 9000).select("query", "path", "start_line", "rank", "used")


@query(f"""with {RANKED}, lv as (select *, string_split(content, chr(10)) as a from rk)
select query, path, start_line, md5(case when rank = 1 or language = 'fr' or len(a) <= 14 then content else array_to_string(list_slice(a, 1, 14), chr(10)) || chr(10) || '... [compressed]' end) as content from lv""")
def evidence_levels(spark, d):
    ranked = ranked_chunks(spark, d).withColumn("language", F.when(F.col("language") == "fr", "sql").otherwise(F.col("language")))
    return packing.evidence_levels(ranked).select("query", "path", "start_line", F.md5("content").alias("content"))


@query()
def greedy_pack(spark, d):
    return packing.greedy_pack(ranked_chunks(spark, d), 6000).select("query", "path", "start_line", "end_line", "rank", "cost", "truncated")


@query(f"with {WINDOWS} " + """select a.path, a.start_line as left_start, b.start_line as right_start, round((least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1) / greatest(1, least(a.end_line - a.start_line + 1, b.end_line - b.start_line + 1))::double, 6) as overlap
from windows a join windows b on a.path = b.path and a.start_line < b.start_line and b.start_line <= a.end_line where overlap >= 0.1""")
def overlap_pairs(spark, d):
    w = chunking.line_windows(files(spark, d), 20, 3).select("path", "start_line", "end_line")
    # only neighbours overlap, as a window is longer than the overlap
    after = W.partitionBy("path").orderBy("start_line")
    pairs = w.withColumns({"s": F.lead("start_line").over(after), "e": F.lead("end_line").over(after)}).filter("s is not null")
    ratio = F.round(overlap_ratio(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("path"), F.col("s"), F.col("e")), 6)
    return pairs.select("path", F.col("start_line").alias("left_start"), F.col("s").alias("right_start"), ratio.alias("overlap")).filter("overlap >= 0.1")


