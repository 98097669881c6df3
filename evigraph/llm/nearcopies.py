"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints with pigeonring pruning, then the shingles themselves.

At a similarity of 0.8 the fingerprints of two texts differ in about 10 of 64 bits, so the radius is RADIUS. At such a
radius no chain holds equal segments that are long enough to be looked up by, so rows meet by bands of min-hashes: a pair
of similarity s shares one of BANDS keys with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.9996 at 0.8. Of the pairs that meet,
those whose differing bits leave the budget of every chain of the ring are pruned; what passes the full Hamming check is decided by the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, binary, dealt, kept, record_batch, slices
from evigraph.llm.components import connected_components
from evigraph.llm.simhash import SEED, majority, one_of_each, ring_ok, shingle_hashes

BANDS, ROWS = 20, 5
XOR, ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
ODD |= np.uint64(1)
#: Bits that may differ, over a ring of so many segments; texts of fewer than FEW shingles, whose fingerprints are coarse, go straight to the shingles.
RADIUS, SEGMENTS, FEW = 22, 4, 64
#: A key's group of more rows, or of more shingles, is dealt out in blocks, all of which hold about ANCHORS rows in common.
LARGE, LARGE_SHINGLES, ANCHORS = 4096, 8 << 20, 64
SIGNED = "doc_id long, h long, node long, fp long, n long, keys array<long>"


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[k : k + 2048, None] ^ XOR) * ODD).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * ODD[:BANDS]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def node_of(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes(), SEED)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, h: a hash of the text, node: a hash of its distinct shingles, fp: their SimHash, n: how many they are, keys) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashes = [shingle_hashes(x, shingle) for x in binary(batch.column(1))]
            sets = [np.unique(x) for x in hashes]
            longs = lambda values: np.array(values, np.uint64).view(np.int64)
            yield record_batch(
                {"doc_id": (pa.int64(), batch.column(0)), "h": (pa.int64(), batch.column(2)), "node": (pa.int64(), longs([node_of(x) for x in sets])), "fp": (pa.int64(), longs([majority(x) for x in hashes])),
                 "n": (pa.int64(), [len(x) for x in sets]), "keys": (pa.list_(pa.int64()), [band_keys(x) if len(x) else [] for x in sets])}
            )

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, SIGNED)


def shingle_sets(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles: the lower 32 bits of its distinct shingles, ascending) for each row of docs with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [x for x in (np.unique(shingle_hashes(x, shingle)) for x in binary(batch.column(0))) if len(x)]
            yield record_batch({"node": (pa.int64(), np.array([node_of(x) for x in sets], np.uint64).view(np.int64)), "shingles": (pa.binary(), [np.unique(x.astype(np.uint32)).tobytes() for x in sets])})

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "node long, shingles binary")


class Group:
    """Rows that meet under a key: their fingerprints and shingles."""

    def __init__(self, fps: np.ndarray, sets: list[np.ndarray], alike: float):
        self.fps, self.alike = fps.view(np.uint64), alike
        self.size = np.array([len(x) for x in sets], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(self.words), bool)

    def near(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are alike enough."""
        small, large = np.minimum(self.size[x], self.size[others]), np.maximum(self.size[x], self.size[others])
        others = others[(small >= self.alike * large - 1e-9)]
        far = self.size[others] >= FEW if self.size[x] >= FEW else np.zeros(len(others), bool)
        far[far] = ~ring_ok(self.fps[x] ^ self.fps[others[far]], SEGMENTS, RADIUS)
        others = others[~far]
        if not len(others):
            return others
        sizes = self.size[others]
        ends = np.cumsum(sizes)
        own = self.flat[self.start[x] : self.start[x] + self.size[x]]
        self.mark[own] = True
        both = np.add.reduceat(self.mark[self.flat[np.repeat(self.start[others] - ends + sizes, sizes) + np.arange(ends[-1])]].astype(np.int64), ends - sizes)
        self.mark[own] = False
        return others[both >= self.alike * (self.size[x] + sizes - both) - 1e-9]

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links that join what all links would join."""
        left = np.arange(len(self.fps))
        while len(left) > 1:
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                if len(found := self.near(x, left)):
                    yield from ((x, int(y)) for y in found)
                    queue += found.tolist()
                    left = np.setdiff1d(left, found, assume_unique=True)

    def across(self, apart: np.ndarray, roots: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links from rows that are marked as apart to rows of other roots, one for each pair of roots at least."""
        for x in np.flatnonzero(apart):
            found = self.near(int(x), np.flatnonzero(roots != roots[x]))
            for y in found:
                if roots[y] != roots[x]:
                    yield int(x), int(y)
                    roots[roots == roots[x]] = roots[y]


def group_links(rows: DataFrame, alike: float) -> DataFrame:
    """rows (key, block, node, fp, shingles, apart, root) -> links (a, b) between nodes of one key and block. Nodes may repeat in a group."""

    def of(held: list[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
        column = lambda i: pa.chunked_array([b.column(i) for b in held]).to_numpy()
        nodes, at = np.unique(column(2), return_index=True)
        if len(nodes) < 2:
            return
        shown = [x for b in held for x in b.column(4)]
        group = Group(column(3)[at], [np.frombuffer(shown[k].as_buffer(), np.uint32) for k in at], alike)
        apart = np.isin(nodes, column(2)[column(5)])
        for a, b in group.across(apart, column(6)[at].copy()) if apart.any() else group.forest():
            yield int(nodes[a]), int(nodes[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, blocks = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])])
            out: list[tuple[int, int]] = []
            for s, e in zip(edges, np.r_[edges[1:], batch.num_rows], strict=True):
                name = int(keys[s]), int(blocks[s])
                if held and name != last:
                    out += of(held)
                    held = []
                held.append(batch.slice(int(s), int(e - s)))
                last = name
            yield record_batch({"a": (pa.int64(), [x for x, _ in out]), "b": (pa.int64(), [x for _, x in out])})
        if held:
            out = list(of(held))
            yield record_batch({"a": (pa.int64(), [x for x, _ in out]), "b": (pa.int64(), [x for _, x in out])})

    rows = rows.select("key", "block", "node", "fp", "shingles", "apart", "root").repartition("key", "block").sortWithinPartitions("key", "block")
    return rows.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8) -> DataFrame:
    """(doc_id, h, root) for each row of docs: rows have one root if links of at least that similarity lead from one to the other.

    The distinct sets of shingles that share a key meet in a task, which gives a spanning forest of their links. A group
    over the limits is dealt out in blocks that have some rows in common; then those that aren't in the group's main component are held
    against the whole group once more, so that no link between components is missed. Texts without a word are alike. Null texts
    count as empty, rows with null or repeated ids have a row each, no rows give no rows, other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    rows = scratch.written("rows", dealt(signatures(docs, id_col, text_col, shingle)))
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "fp", "n", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).filter("rows > 1")
    blocks = F.greatest(F.ceil(F.col("rows") / F.lit(LARGE)), F.ceil(F.col("shingles") / F.lit(LARGE_SHINGLES)))
    members = kept(keyed.join(groups.hint("merge"), "key").select("key", "node", "fp", "rows", F.least(blocks, F.col("rows")).alias("blocks")))
    large = members.filter("blocks > 1")
    any_large = not large.isEmpty()
    once = shingle_sets(docs, text_col, shingle).groupBy("node").agg(F.first("shingles").alias("shingles"))  # copies give way before they are shuffled
    sets = once.join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    sets = scratch.written("sets", sets) if any_large else sets
    own, all_of = F.array(F.pmod(F.xxhash64("node"), "blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    met = members.withColumn("block", F.explode(F.when((F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", "key"), "rows") < ANCHORS), all_of).otherwise(own)))
    met = met.withColumns({"apart": F.lit(False), "root": F.col("node")})
    links = scratch.written("links", dealt(group_links(met.join(sets.hint("merge"), "node"), alike)))
    roots = connected_components(links)
    if any_large:
        named = scratch.written("large", dealt(large.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))))
        main = named.groupBy("key", "root").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("root", F.struct("times", "root")).alias("main"))
        apart = named.join(main.hint("merge"), "key").withColumn("apart", F.col("root") != F.col("main"))
        once = apart.withColumn("block", own[0]).withColumn("apart", F.lit(False)).drop("main")
        again = apart.filter("apart").withColumn("block", F.explode(all_of)).drop("main")
        more = group_links(once.unionByName(again).join(sets.hint("merge"), "node"), alike)
        roots = connected_components(scratch.written("more", dealt(links.union(more))))
    members.unpersist()
    scratch.drop("sets")
    return rows.select("doc_id", "h", "node").join(roots.hint("merge"), "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, alike: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each component one row, as simhash.one_of_each chooses it."""
    return one_of_each(docs, near_copies(docs, id_col, text_col, shingle, alike), id_col, text_col)
