"""Exact and prefix lookup of nodes by several terms at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.scores import bm25_norm
from evigraph.functions.text import normalize_search
from evigraph.operators import search


def normalized(nodes: DataFrame) -> DataFrame:
    """nodes with the columns that lookups compare; a snapshot stores them, so that prefixes prune row groups."""
    return nodes.withColumns({f"{c}_normalized": normalize_search(F.col(c)) for c in ("name", "qualified_name", "path")})


def term_hits(nodes: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """terms (term_index, term) -> (term_index, node_id, qualified_name, score), the best `limit` nodes of each term.

    1.0 for an equal name or qualified name, .85, .8 and .72 for a prefix of name, qualified name and path. A prefix is
    literal. Terms are few and go to every task; a simple name equals the normalised name, so its own rule of .95 never
    applies. Ties go by qualified name, then id. Blank terms find nothing."""
    t = terms.select("term_index", normalize_search(F.col("term")).alias("t")).filter("t <> ''")
    n = normalized(nodes).select("node_id", "qualified_name", F.col("name_normalized").alias("n"), F.col("qualified_name_normalized").alias("q"), F.coalesce("path_normalized", F.lit("")).alias("p"))
    score = F.expr("case when n = t or q = t then 1.0D when startswith(n, t) then 0.85D when startswith(q, t) then 0.80D when startswith(p, t) then 0.72D end")
    # a node and a term must share their first letter; that makes the join one on equal keys
    first = lambda c: F.substring(c, 1, 1)
    keyed = n.withColumn("k", F.explode(F.array_distinct(F.array(first("n"), first("q"), first("p")))))
    hits = keyed.join(F.broadcast(t.withColumn("k", first("t"))), "k").withColumn("score", score).filter("score is not null").dropDuplicates(["term_index", "node_id"])
    rank = F.row_number().over(W.partitionBy("term_index").orderBy(F.desc("score"), "qualified_name", "node_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("term_index", "node_id", "qualified_name", "score", "rank")


def exact_nodes(nodes: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """The best score of each node over all terms, the best `limit` nodes. Ties go by first term, then rank there."""
    hits = term_hits(nodes, terms, limit)
    best = hits.groupBy("node_id", "qualified_name").agg(F.max("score").alias("score"), F.min(F.struct("term_index", "rank")).alias("seen"))
    return best.orderBy(F.desc("score"), "seen.term_index", "seen.rank", "node_id").limit(limit).select("node_id", "qualified_name", "score")


def exact_or_full_text(nodes: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """As exact_nodes, but while the terms so far have found fewer than `limit` nodes, a term also adds full-text hits of its words as prefixes.

    Terms are few and each finds at most `limit` nodes either way, so the hits are merged in the driver, term by term."""
    weights = {c: w for c, w in search.NODE_WEIGHTS.items() if c in nodes.columns}
    texts = search.search(nodes, "node_id", weights, terms.select(F.col("term_index").alias("query"), F.col("term").alias("text")), limit, prefix=True)
    full = texts.select(F.col("query").alias("term_index"), F.col("doc").alias("node_id"), search.node_score(bm25_norm(F.col("score"))).alias("score"), "rank")
    full = full.join(nodes.select("node_id", "qualified_name"), "node_id").select("term_index", "node_id", "qualified_name", "score", "rank")
    first, more = (sorted(df.collect(), key=lambda r: (r["term_index"], r["rank"])) for df in (term_hits(nodes, terms, limit), full))
    best: dict[str, tuple[str, float]] = {}
    for term in sorted({r["term_index"] for r in [*first, *more]}):
        for hits in (first, more):
            if hits is first or len(best) < limit:
                for r in hits:
                    if r["term_index"] == term and (r["node_id"] not in best or r["score"] > best[r["node_id"]][1]):
                        best[r["node_id"]] = (r["qualified_name"], r["score"])
    rows = sorted(((n, q, s) for n, (q, s) in best.items()), key=lambda r: -r[2])[:limit]
    return nodes.sparkSession.createDataFrame(rows, "node_id string, qualified_name string, score double")


def preferred(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """Hits of the given kinds, or all where none is of them."""
    wanted = F.col("kind").isin(*kinds)
    return hits.withColumn("any", F.max(wanted).over(W.partitionBy())).filter(wanted | ~F.col("any")).drop("any")


def prefix_search(nodes: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    p = normalize_search(F.lit(prefix))
    return normalized(nodes).filter(F.startswith(F.col("name_normalized"), p)).orderBy("name_normalized", "node_id").limit(limit).select("node_id", "name")
