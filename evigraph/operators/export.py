"""The graph as Mermaid, GraphML or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aliased(nodes: DataFrame) -> DataFrame:
    """nodes with an alias n1, n2 ... by id. An export is a bounded view, which one task numbers."""
    return nodes.withColumn("alias", F.concat(F.lit("n"), F.row_number().over(W.orderBy("node_id")).cast("string")))


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line_no, line). Labels are qualified names with single quotes for double ones, cut at 100 characters."""
    n = aliased(nodes)
    label = F.substring(F.replace("qualified_name", F.lit('"'), F.lit("'")), 1, 100)
    head = n.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("graph LR").alias("line"))
    body = n.select(F.lit(1).alias("part"), F.col("node_id").alias("a"), F.lit("").alias("b"), F.concat(F.lit("    "), "alias", F.lit('["'), label, F.lit('"]')).alias("line"))
    s, t = n.select(F.col("node_id").alias("source_id"), F.col("alias").alias("s")), n.select(F.col("node_id").alias("target_id"), F.col("alias").alias("t"))
    arcs = edges.join(s, "source_id").join(t, "target_id").select(F.lit(2).alias("part"), F.concat("source_id", F.lit("\x1f"), "target_id").alias("a"), F.col("relation").alias("b"), F.concat(F.lit("    "), "s", F.lit(" -->|"), "relation", F.lit("| "), "t").alias("line"))
    whole = head.union(body).union(arcs)
    return whole.select(F.row_number().over(W.orderBy("part", "a", "b", "line")).alias("line_no"), "line")


def escaped(c: str):
    x = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("a"), F.concat(F.lit('    <node id="'), escaped("node_id"), F.lit('"><data key="kind">'), escaped("kind"), F.lit('</data><data key="name">'), escaped("qualified_name"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2), F.concat_ws("\x1f", "source_id", "relation", "target_id"), F.concat(F.lit('    <edge source="'), escaped("source_id"), F.lit('" target="'), escaped("target_id"), F.lit('"><data key="relation">'), escaped("relation"), F.lit("</data></edge>")))
    frame = n.sparkSession.createDataFrame([(0, "0", '<?xml version="1.0" encoding="UTF-8"?>'), (0, "1", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (0, "2", '  <graph edgedefault="directed">'), (3, "0", "  </graph>"), (3, "1", "</graphml>")], "part int, a string, line string")
    return frame.union(n).union(e).select(F.row_number().over(W.orderBy("part", "a", "line")).alias("line_no"), "line")


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("value")).union(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns))))


def write(lines: DataFrame, path: str) -> None:
    """One text file, in order."""
    order, column = ("line_no", "line") if "line_no" in lines.columns else ("value", "value")
    lines.coalesce(1).sortWithinPartitions(order).select(column).write.mode("overwrite").text(path)
