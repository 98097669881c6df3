"""Resolution of references to nodes, and the relations that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.classify import production_name
from evigraph.functions.routes import contract_matches, method_of, segments
from evigraph.functions.text import casefold

#: Relations that are resolved, and the confidences of what follows. Fixed values.
RESOLVED = ("DEPENDS_ON", "EXTENDS", "IMPLEMENTS", "CALLS", "CALLS_ENDPOINT", "CONFIGURED_BY")
CONFIDENCE = {"endpoint": 0.96, "dotted": 0.92, "simple": 0.78, "tests": 0.9, "layers": 0.88}
#: Kinds that a simple name never stands for. Fixed values.
NOT_SIMPLE = ("external_symbol", "file", "package")


def unique(candidates: DataFrame, key: str, value: str = "node_id") -> DataFrame:
    """(key, value) of the keys that have one value alone."""
    return candidates.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).filter("__n = 1").select(key, value)


def sole(references: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(ref, node_id) of the references (ref, keys) for which there is one candidate (node_id, keys) alone.

    Least and greatest node of each key stand for all its candidates, so a key that many references and many nodes share isn't expanded into their pairs."""
    ends = candidates.groupBy(*keys).agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("__last"))
    return references.join(ends, keys).groupBy("ref").agg(F.min("node_id").alias("node_id"), F.max("__last").alias("__last")).filter("node_id = __last").select("ref", "node_id")


def simple_name(raw: Column) -> Column:
    return F.substring_index(F.substring_index(raw, "#", 1), ".", -1)


def resolve(references: DataFrame, nodes: DataFrame, any_method: bool = False) -> DataFrame:
    """references (ref, relation, qualified_name) -> (ref, node_id, strategy); references that no strategy resolves to one node alone are left out.

    A call of owner#method: the one method of that owner and name, else the owner. Then the one node with the qualified name.
    A call of an endpoint: the one endpoint whose contract matches, or nothing. Then the one node with the simple name,
    unless it is external, a file or a package."""
    n = nodes.select("node_id", "kind", casefold(F.col("qualified_name")).alias("q"), casefold(F.col("name")).alias("simple"))
    refs = references.select("ref", "relation", casefold(F.col("qualified_name")).alias("raw")).withColumn("owner", F.substring_index("raw", "#", 1))
    methods = n.filter(F.contains("q", F.lit("#"))).withColumn("owner", F.substring_index("q", "#", 1)).select("owner", F.col("simple").alias("method"), "node_id")
    calls = refs.filter((F.col("relation") == "CALLS") & F.contains("raw", F.lit("#"))).withColumn("method", F.regexp_extract("raw", r"#([^/]*)", 1))
    by_method = sole(calls, methods, ["owner", "method"])
    target = F.when((F.col("relation") == "CALLS") & F.contains("raw", F.lit("#")), F.col("owner")).otherwise(F.col("raw"))
    refs = refs.withColumn("target", target)
    by_name = sole(refs, n.filter("kind <> 'external_symbol'").select(F.col("q").alias("target"), "node_id"), ["target"])
    ends = n.filter("kind = 'endpoint'").select("node_id", F.col("q").alias("provider"))
    clients = refs.filter("relation = 'CALLS_ENDPOINT'").select("ref", F.col("raw").alias("client"))
    on_size = lambda df, c: df.withColumn("size", F.size(segments(F.col(c)))).withColumn("method", method_of(F.col(c)))
    left, right = on_size(clients, "client"), on_size(ends, "provider")
    if any_method:  # a provider of ANY is a candidate of every method
        right = right.withColumn("method", F.explode(F.when(F.col("method") == "any", F.array(*[F.lit(m) for m in ("get", "post", "put", "patch", "delete", "head", "options", "any")])).otherwise(F.array("method"))))
    matched = left.join(right, ["method", "size"]).filter(contract_matches(F.col("provider"), F.col("client")))
    by_contract = unique(matched, "ref")
    simple = refs.filter("relation <> 'CALLS_ENDPOINT'").withColumn("simple", simple_name(F.col("target")))
    by_simple = sole(simple, n.filter(~F.col("kind").isin(*NOT_SIMPLE)).select("simple", "node_id"), ["simple"])
    out = None
    for k, (name, found) in enumerate((("method", by_method), ("qualified", by_name), ("contract", by_contract), ("simple", by_simple))):
        rows = found.select("ref", "node_id", F.lit(name).alias("strategy"), F.lit(k).alias("k"))
        out = rows if out is None else out.union(rows)
    best = out.groupBy("ref").agg(F.min(F.struct("k", "node_id", "strategy")).alias("b"))
    return best.select("ref", "b.node_id", "b.strategy")


def derived_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """RESOLVED_<relation> from a source with a path to what its external target resolves to, unless that is the source itself."""
    external = nodes.filter("kind = 'external_symbol'").select(F.col("node_id").alias("target_id"), "qualified_name")
    raw = edges.filter(F.col("relation").isin(*RESOLVED)).join(external, "target_id").select("source_id", "relation", "target_id", "qualified_name", F.concat_ws("\x1f", "relation", "qualified_name").alias("ref")).distinct()
    found = resolve(raw.select("ref", "relation", "qualified_name").distinct(), nodes)
    placed = nodes.filter(F.col("path").isNotNull()).select(F.col("node_id").alias("source_id"), F.col("path").alias("owner_path"))
    sure = F.when(F.col("relation") == "CALLS_ENDPOINT", CONFIDENCE["endpoint"]).when(F.contains("qualified_name", F.lit(".")), CONFIDENCE["dotted"]).otherwise(CONFIDENCE["simple"])
    out = raw.join(found, "ref").filter("node_id <> source_id").join(placed, "source_id")
    return out.select("source_id", F.concat(F.lit("RESOLVED_"), "relation").alias("relation"), F.col("node_id").alias("target_id"), F.concat(F.lit("@derived:"), "owner_path").alias("evidence_path"), sure.alias("confidence")).distinct()


def test_links(nodes: DataFrame) -> DataFrame:
    """nodes (node_id, name, layer) -> TESTS from each test to the one node with its production name that is no test."""
    tests = nodes.filter("layer = 'test'").select(F.col("node_id").alias("source_id"), casefold(production_name(F.col("name"))).alias("simple"))
    others = nodes.filter("layer <> 'test'").select("node_id", casefold(F.col("name")).alias("simple"))
    return unique(tests.join(others, "simple"), "source_id").select("source_id", F.lit("TESTS").alias("relation"), F.col("node_id").alias("target_id"), F.lit(CONFIDENCE["tests"]).alias("confidence"))


def layered(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(controller, service, repository): for each controller the first service that it depends on and that depends on a repository, with the first of these."""
    of = lambda layer: layers.filter(F.col("layer") == layer).select("node_id")
    hop = lambda a, b, x, y: edges.join(of(a), F.col("source_id") == F.col("node_id"), "left_semi").join(of(b), F.col("target_id") == F.col("node_id"), "left_semi").select(F.col("source_id").alias(x), F.col("target_id").alias(y)).distinct()
    first = hop("service", "repository", "service", "repository").groupBy("service").agg(F.min("repository").alias("repository"))
    best = hop("controller", "service", "controller", "service").join(first, "service").groupBy("controller").agg(F.min(F.struct("service", "repository")).alias("b"))
    return best.select("controller", "b.service", "b.repository")


def reference_keys() -> Column:
    """For references (relation, qualified_name): what a node must have in common with one to resolve it, by the strategies of resolve()."""
    raw = casefold(F.col("qualified_name"))
    call = (F.col("relation") == "CALLS") & F.contains(raw, F.lit("#"))
    owner = F.substring_index(raw, "#", 1)
    target = F.when(call, owner).otherwise(raw)
    method = F.when(call, F.concat(F.lit("m:"), owner, F.lit("#"), F.regexp_extract(raw, r"#([^/]*)", 1)))
    contract = F.when(F.col("relation") == "CALLS_ENDPOINT", _contract_key(raw))
    return F.array_compact(F.array(F.concat(F.lit("q:"), target), F.concat(F.lit("s:"), simple_name(target)), method, contract))


def node_keys() -> Column:
    """The same for nodes (kind, name, qualified_name)."""
    q, name = casefold(F.col("qualified_name")), casefold(F.col("name"))
    method = F.when(F.contains(q, F.lit("#")), F.concat(F.lit("m:"), F.substring_index(q, "#", 1), F.lit("#"), name))
    contract = F.when(F.col("kind") == "endpoint", _contract_key(q))
    return F.array_compact(F.array(F.concat(F.lit("q:"), q), F.concat(F.lit("s:"), name), method, contract))


def _contract_key(contract: Column) -> Column:
    return F.concat(F.lit("e:"), method_of(contract), F.lit(":"), F.size(segments(contract)).cast("string"))


def affected_owners(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths with a reference that may resolve otherwise now that `changed` (kind, name, qualified_name), old and new rows, have come, gone or changed."""
    external = nodes.filter("kind = 'external_symbol'").select(F.col("node_id").alias("target_id"), "qualified_name")
    refs = edges.filter(F.col("relation").isin(*RESOLVED)).join(external, "target_id").select("source_id", F.explode(reference_keys()).alias("key"))
    hit = refs.join(changed.select(F.explode(node_keys()).alias("key")).distinct(), "key", "left_semi").select("source_id").distinct()
    placed = nodes.filter(F.col("path").isNotNull()).select(F.col("node_id").alias("source_id"), "path")
    return hit.join(placed, "source_id").select("path").distinct()


def reference_owners(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths whose edges refer to an external symbol with the name or qualified name of one of changed (name, qualified_name)."""
    external = nodes.filter("kind = 'external_symbol'").select(F.col("node_id").alias("target_id"), casefold(F.col("qualified_name")).alias("q"), casefold(F.col("name")).alias("n"))
    q = changed.select(casefold(F.col("qualified_name")).alias("q")).distinct()
    n = changed.select(casefold(F.col("name")).alias("n")).distinct()
    hit = external.join(q, "q", "left_semi").select("target_id").union(external.join(n, "n", "left_semi").select("target_id")).distinct()
    source = nodes.filter(F.col("path").isNotNull()).select(F.col("node_id").alias("source_id"), "path")
    return edges.join(hit, "target_id", "left_semi").join(source, "source_id").select("path").distinct()
