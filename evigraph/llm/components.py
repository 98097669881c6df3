"""Connected components of an undirected graph given as rows, by hooking parents and jumping to grandparents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch

#: Up to so many rows of edges, repeats included, are joined on the driver (4 MB), which writes no tables; more of them go by rounds.
FEW = 1 << 18


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, ascending, and the root of each: trees hook onto smaller ones that an edge leads to, until no edge leads out of a tree."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    up, one, two = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(one):
        one, two = up[one], up[two]
        apart = one != two
        one, two = one[apart], two[apart]
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while (up != up[up]).any():
            up = up[up]
    return nodes, nodes[up]


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any order and with repeats -> (node, root); root is the smallest node that can be reached.

    Edges are counted first, so they should be a table that is already written. FEW are joined on the driver; with more, each round every node hears its neighbours' smallest grandparent; what it hears lowers its own parent and its
    parent's parent, and each parent gives way to a grandparent. As whole trees are hooked, not nodes, rounds grow
    with the logarithm of the longest path. Each round is written to the shared folder and read again, so that no plan, statistic or
    partitioning is carried on; of the rounds only the last one stays there. Proposals are aggregated before they are
    shuffled, and no row holds more than a few longs. No edges: no rows. Self loops keep a lone node; edges with a null end are left out."""
    ends = edges.select("a", "b").filter("a is not null and b is not null")
    if ends.count() <= FEW:
        found = ends.toArrow()
        names, roots = joined(*(found.column(x).to_numpy() for x in ("a", "b")))
        return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(names, pa.int64()), "root": pa.array(roots, pa.int64())}))
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.written("edges", ends.union(ends.select("b", "a")).distinct())
    parents = scratch.written("0", edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
    turn = 0
    while True:
        above = parents.select(F.col("node").alias("at"), F.col("up").alias("grand"))
        known = parents.join(above.hint("merge"), parents["up"] == above["at"]).select("node", "up", "grand")
        heard = edges.join(known.select(F.col("node").alias("b"), "grand").hint("merge"), "b").groupBy(F.col("a").alias("of")).agg(F.min("grand").alias("heard"))
        low = F.least("grand", F.coalesce("heard", "grand"))
        found = known.join(heard, known["node"] == heard["of"], "left").select("node", "up", low.alias("low"))
        proposals = found.select("node", "low", F.col("up").alias("was")).union(found.select("up", "low", F.lit(None).cast("long")))
        turn += 1
        parents = scratch.written(str(turn), proposals.groupBy("node").agg(F.min("low").alias("up"), F.max("was").alias("was")))
        scratch.drop(str(turn - 1))
        if parents.filter("up <> was").isEmpty():
            scratch.drop("edges")
            return parents.select("node", F.col("up").alias("root"))
        parents = parents.select("node", "up")
