"""Walks, neighbourhoods, degrees and bounded views of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids (node_id), as (relation, source_id, target_id, node_id, other). Each direction is a join of its own: one with OR would compare all pairs."""
    out = edges.join(ids, edges["source_id"] == ids["node_id"]).select("relation", "source_id", "target_id", "node_id", F.col("target_id").alias("other"))
    back = edges.join(ids, edges["target_id"] == ids["node_id"]).select("relation", "source_id", "target_id", "node_id", F.col("source_id").alias("other"))
    return out.union(back)


def graph_walk(edges: DataFrame, starts: DataFrame, relations: list[str] | None = None, depth: int = 2, max_nodes: int = 40) -> DataFrame:
    """(node_id, distance, relation): nodes around starts (node_id), breadth first, both ways along edges.

    A hop takes edges by relation, source and target; a new node has the first relation that reaches it; the hop that
    would pass max_nodes is cut there. Starts don't count. No relations: all. The frontier has at most max_nodes rows."""
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    edges = edges.select("source_id", "relation", "target_id")
    frontier = starts.select("node_id").distinct()
    seen, found, left = frontier, None, max_nodes
    for hop in range(1, depth + 1):
        reached = touching(edges, F.broadcast(frontier)).withColumnRenamed("node_id", "from").withColumnRenamed("other", "node_id")
        fresh = reached.join(F.broadcast(seen), "node_id", "left_anti")
        first = fresh.groupBy("node_id").agg(F.min(F.struct("relation", "source_id", "target_id")).alias("by"))
        rows = first.orderBy("by", "node_id").limit(left).select("node_id", F.lit(hop).alias("distance"), F.col("by.relation").alias("relation"))
        got = rows.collect()  # at most max_nodes
        if not got:
            break
        step = edges.sparkSession.createDataFrame(got, rows.schema)
        found = step if found is None else found.union(step)
        frontier, seen, left = step.select("node_id"), seen.union(step.select("node_id")), left - len(got)
        if left <= 0:
            break
    return found if found is not None else edges.sparkSession.createDataFrame([], "node_id string, distance int, relation string")


def reach(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start_id, node_id, distance): as graph_walk for many starts at once, without a quota; nothing reaches the driver."""
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.inline(F.array(way("source_id", "target_id"), way("target_id", "source_id"))))  # one pass over edges; what is reached twice is dropped after the hop
    seen = starts.select(F.col("node_id").alias("start_id"), "node_id", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(both, frontier["node_id"] == both["a"]).select("start_id", F.col("b").alias("node_id")).distinct()
        frontier = step.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").withColumn("distance", F.lit(hop))
        seen = seen.union(frontier)
    return seen.filter("distance > 0")


def named_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with the names of both ends."""
    s = nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("target_name"))
    return edges.join(s, "source_id").join(t, "target_id")


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, limit: int = 50) -> DataFrame:
    """Edges at seeds (node_id) with the names of their ends, by confidence, then relation, source, target and place."""
    ids = F.broadcast(seeds.select("node_id").distinct())
    near = edges.join(ids, F.col("source_id") == F.col("node_id"), "left_semi").union(edges.join(ids, F.col("target_id") == F.col("node_id"), "left_semi")).distinct()
    order = [F.desc("confidence"), "relation", "source_id", "target_id", "evidence_path", "start_line"]
    few = near.orderBy(*order).limit(limit)
    return named_edges(nodes, few).select("relation", "source_id", "target_id", "evidence_path", "start_line", "end_line", "confidence", "source_name", "target_name")


def architecture_lines(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 24) -> DataFrame:
    """(line): source --RELATION--> target of edges at ids, once each, by confidence."""
    near = touching(edges, F.broadcast(ids.select("node_id").distinct())).select("source_id", "relation", "target_id").distinct()
    whole = edges.join(near, ["source_id", "relation", "target_id"], "left_semi")
    best = named_edges(nodes, whole).groupBy("source_name", "relation", "target_name").agg(F.max("confidence").alias("c"))
    line = F.concat("source_name", F.lit(" --"), "relation", F.lit("--> "), "target_name")
    return best.select(line.alias("line"), "c").orderBy(F.desc("c"), "line").limit(limit).select("line")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with their number of edge ends; a loop counts twice."""
    ends = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 48, hidden: tuple[str, ...] = ("persona", "policy", "relation_policy", "node_kind_policy", "tag_policy")) -> DataFrame:
    """The nodes with the most edge ends, by name, then id."""
    return degrees(nodes.filter(~F.col("kind").isin(*hidden)), edges).orderBy(F.desc("degree"), "qualified_name", "node_id").limit(limit).select("node_id", "kind", "name", "degree")


def induced(edges: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """Edges between ids, the surest first. ids may be many: Spark broadcasts them only where they are small."""
    few = ids.select("node_id").distinct()
    inner = edges.join(few, F.col("source_id") == F.col("node_id"), "left_semi").join(few, F.col("target_id") == F.col("node_id"), "left_semi")
    return inner.orderBy(F.desc("confidence"), "source_id", "relation", "target_id").limit(limit).select("source_id", "relation", "target_id", "evidence_path", F.round("confidence", 3).alias("confidence"))


def ego(nodes: DataFrame, edges: DataFrame, ids: DataFrame, limit: int = 64) -> DataFrame:
    """ids and their neighbours, ids first, then by id."""
    seeds = ids.select("node_id").distinct()
    around = touching(edges, F.broadcast(seeds)).select(F.col("other").alias("node_id"), F.lit(1).alias("distance")).union(seeds.select("node_id", F.lit(0)))
    near = around.groupBy("node_id").agg(F.min("distance").alias("distance")).join(nodes, "node_id")
    return near.orderBy("distance", "node_id").limit(limit).select("node_id", "kind", "name", "distance")


def orphans(nodes: DataFrame, edges: DataFrame, kind: str = "external_symbol") -> DataFrame:
    """Nodes of a kind without an edge."""
    ends = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id"))
    return nodes.filter(F.col("kind") == kind).join(ends, "node_id", "left_anti")


def owners_touching(edges: DataFrame, nodes: DataFrame, paths: DataFrame, layer: str = "@derived") -> DataFrame:
    """Paths of edges of a layer with an end in one of the paths (path)."""
    there = nodes.join(paths, "path", "left_semi").select("node_id")
    own = edges.filter(F.startswith("evidence_path", F.lit(layer)))
    hit = own.join(there, own["source_id"] == there["node_id"], "left_semi").union(own.join(there, own["target_id"] == there["node_id"], "left_semi"))
    return hit.select("evidence_path").distinct()
