"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into a ring of SEGMENTS segments. If two fingerprints differ in at most LINK bits, then some
segment starts a chain all of whose prefixes stay within a proportional budget: the first l segments hold at most
floor(l * LINK / SEGMENTS) differing bits. With 7 segments and 3 bits the budgets are 0, 0, 1, 1, 2, 2, 3. So two
segments at the start are equal, and of the next two one is: their three make the lookup key (27 or 28 bits, 14 keys a
fingerprint). Pairs that share a key must pass the whole chain before the full Hamming check. nearcopies.py has the
operator for a similarity of shingles, which needs a wider radius than exact keys can serve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import binary, cut, dealt, record_batch, slices, table, unused
from evigraph.llm.components import connected_components

SEED = 42
LINK = 3
SEGMENTS = 7
#: Groups up to SMALL rows give every link; larger ones a spanning forest; those over LARGE are first split by one more equal segment.
SMALL, LARGE = 64, 20_000


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    width, masks, low = 64 // segments, [], 0
    for k in range(segments):
        bits = width if k < segments - 1 else 64 - low
        masks.append(((1 << bits) - 1) << low)
        low += bits
    return masks


def budgets(segments: int = SEGMENTS, link: int = LINK) -> list[int]:
    return [length * link // segments for length in range(1, segments + 1)]


def key_masks() -> list[int]:
    """The bits of key 2 * start + v: segments start, start + 1 and start + 2 + v of the ring."""
    m = segment_masks()
    return [m[i] | m[(i + 1) % SEGMENTS] | m[(i + 2 + v) % SEGMENTS] for i in range(SEGMENTS) for v in (0, 1)]


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of each run of `shingle` words, repeats included; of all words where there are fewer; none without a word."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[words[k:] for k in range(shingle)], strict=False) if len(words) >= shingle else [words]
    return np.array([h(join(x), SEED) for x in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts, shown = np.zeros(64, np.int64), hashes.astype(">u8")
    for k in range(0, len(hashes), 32768):
        counts += np.unpackbits(shown[k : k + 32768].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, h: a hash of the text, fp: signed long) per row of docs. Null texts count as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = np.array([fingerprint(x, shingle) for x in binary(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield record_batch({"doc_id": (pa.int64(), batch.column(0)), "h": (pa.int64(), batch.column(2)), "fp": (pa.int64(), fps)})

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), text, F.xxhash64(text)).mapInArrow(run, "doc_id long, h long, fp long")


def chain_ok(x: np.ndarray, start: np.ndarray | int, segments: int = SEGMENTS, link: int = LINK) -> np.ndarray:
    """Do the differing bits x stay in budget along the chain from that segment, and in all within `link`?"""
    masks, limit = np.array(segment_masks(segments), np.uint64), budgets(segments, link)
    total, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
    for step in range(segments):
        total = total + np.bitwise_count(x & masks[(start + step) % segments])
        ok &= total <= limit[step]
    return ok


def ring_ok(x: np.ndarray, segments: int, link: int) -> np.ndarray:
    """Does any segment start such a chain? True of all x of at most `link` bits, and of no others."""
    ok = np.zeros(x.shape, bool)
    for start in range(segments):
        rest = np.flatnonzero(~ok)
        ok[rest] = chain_ok(x[rest], start, segments, link)
    return ok


def forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of those links whose chain starts there."""
    left, one, two = np.arange(len(fps)), [], []
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            at, queue = queue[:64], queue[64:]
            x = fps[at][:, None] ^ fps[left][None, :]
            near = np.bitwise_count(x) <= LINK
            near &= chain_ok(x, start)
            if (hit := near.any(0)).any():
                one.append(at[near[:, hit].argmax(0)])
                two.append(left[hit])
                queue, left = np.r_[queue, left[hit]], left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (none, none)


def _links(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, block, fp) sorted by the first three -> links (a, b, null, null); groups over most rows come back as rows (null, fp, key, part)."""

    def unread(keys, parts, fps) -> pa.RecordBatch:
        return record_batch({"a": (pa.int64(), pa.nulls(len(fps), pa.int64())), "b": (pa.int64(), fps), "key": (pa.int64(), keys), "part": (pa.int64(), parts)})

    def emit(keys, parts, blocks, fps) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]) | (blocks[1:] != blocks[:-1])])
        sizes = np.diff(np.r_[new, len(keys)])
        bits = fps.view(np.uint64)
        group = np.repeat(np.arange(len(new)), sizes)
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        for d in range(1, SMALL):
            at = at[at + d < len(fps)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            ok = at[np.bitwise_count(bits[at] ^ bits[at + d]) <= LINK]
            ok = ok[chain_ok(bits[ok] ^ bits[ok + d], keys[ok] % (2 * SEGMENTS) // 2)]
            a.append(fps[ok])
            b.append(fps[ok + d])
        for k in np.flatnonzero(sizes > SMALL):
            s = slice(new[k], new[k] + sizes[k])
            if most is not None and sizes[k] > most:
                yield unread(keys[s], parts[s], fps[s])
            else:
                one, two = forest(bits[s], int(keys[new[k]]) % (2 * SEGMENTS) // 2)
                a.append(fps[s][one])
                b.append(fps[s][two])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield record_batch({"a": (pa.int64(), a), "b": (pa.int64(), b), "key": (pa.int64(), none), "part": (pa.int64(), none)})

    held: list[tuple[np.ndarray, ...]] = []
    passed: tuple | None = None  # the group, too large to hold, that is being handed on
    name = lambda rows, i: tuple(int(c[i]) for c in rows[:3])
    for batch in batches:
        now = tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        if passed and len(now[0]):
            mine = np.logical_and.reduce([now[c] == passed[c] for c in range(3)])
            if mine.any():
                yield unread(now[0][mine], now[1][mine], now[3][mine])
            now = tuple(c[~mine] for c in now)
            passed = passed if len(now[0]) == 0 else None
        if not len(now[0]):
            continue
        if held and name(now, -1) == name(held[-1], -1):
            held.append(now)
        else:
            rows = tuple(np.concatenate([h[c] for h in held] + [now[c]]) for c in range(4))
            last = np.flatnonzero(np.logical_or.reduce([rows[c] != rows[c][-1] for c in range(3)]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from emit(*(c[:end] for c in rows))
            held = [tuple(c[end:] for c in rows)]
        if most is not None and sum(len(h[0]) for h in held) > most:
            passed = name(held[-1], -1)
            for h in held:
                yield unread(h[0], h[1], h[3])
            held = []
    if held:
        yield from emit(*(np.concatenate([h[c] for h in held]) for c in range(4)))


LINKS = "a long, b long, key long, part long"


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def further_segments(key: int) -> list[int]:
    """The three segments, among the first six of the chain, that a key leaves open. At most 2 bits differ in them, so one is equal."""
    start, v = divmod(key, 2)
    return [(start + 3 - v) % SEGMENTS, (start + 4) % SEGMENTS, (start + 5) % SEGMENTS]


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp) -> links (a, b) with the same components as all pairs within LINK bits.

    Rows are grouped by key. A group over LARGE is split by one more equal segment of its chain, three ways, which loses
    no pair. A part of it that is still over LARGE holds a cluster; it is dealt out in pairs of blocks, the only step whose rows grow
    faster than the group, by its size over LARGE."""
    bits = lambda masks: [F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]
    grouped = lambda df, most: df.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block").mapInArrow(lambda b: _links(b, most), LINKS)
    unread = lambda df: df.filter("a is null").select("key", "part", F.col("b").alias("fp"))
    keyed = distinct.select("fp", F.posexplode(F.array(*bits(key_masks()))).alias("key", "part"))
    found = cut(dealt(grouped(keyed.select(F.col("key").cast("long"), "part", F.lit(0).cast("long").alias("block"), "fp"), LARGE)))
    over, read = unread(found), found.filter("a is not null").select("a", "b")
    if over.isEmpty():
        return read
    masks, keys = segment_masks(), key_masks()
    wider = F.element_at(F.array(*[F.array(*bits([keys[k] | masks[x] for x in further_segments(k)])) for k in range(2 * SEGMENTS)]), (F.col("key") + 1).cast("int"))
    split = over.select("key", "fp", F.posexplode(wider).alias("way", "part")).select((F.col("key") + F.col("way").cast("long") * (2 * SEGMENTS)).alias("key"), "part", F.lit(0).cast("long").alias("block"), "fp")
    found = cut(dealt(grouped(split, LARGE)))
    over, read = unread(found), read.union(found.filter("a is not null").select("a", "b"))
    if over.isEmpty():
        return read
    blocks = over.groupBy("key", "part").agg(F.ceil(F.count("*") / F.lit(LARGE)).alias("n"))
    pairs = over.join(blocks, ["key", "part"]).withColumn("at", F.pmod(F.xxhash64("fp"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = pairs.select("key", "part", (F.least("at", "other") * F.col("n") + F.greatest("at", "other")).alias("block"), "fp")
    return cut(dealt(read.union(grouped(pairs, None).select("a", "b"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, fp, h) for each row of docs.

    fingerprint: 16 hex digits, as signed long fp. component_id: the smallest doc_id among the rows whose fingerprints can be
    reached by links of at most 3 bits; root: the smallest fingerprint among them, as signed long; h: a hash of the text.
    Null and word-less texts have fingerprint zero and link like others. Null ids never become a component_id unless a
    component has no other. Repeated rows and repeated ids give a row each. An empty table gives no rows. Other columns
    are ignored. The join of rows and their fingerprints stays a sort-merge join, whose hot keys (copies of one text) Spark splits."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(distinct.select("fp")))
    reps = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = reps.join(reps.groupBy("root").agg(F.min("first").alias("component_id")).hint("merge"), "root").select("fp", "root", "component_id")
    return fps.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "fp", "h")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of docs with the smallest id, null ids last, of each root in classes (doc_id, h, root), a row for each of docs.

    Of rows with one id, those of the smallest hash of the text; of rows with one id and text any. Rows that share an id but
    not their root each stay. The names of the columns that are added for a while are none of docs."""
    none, number, h = (unused(docs, x) for x in ("none", "number", "h"))
    chosen = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(number), F.col("h").alias(h))).alias("k")).select("k.*")
    key = F.col(id_col).cast("long")
    tagged = docs.withColumns({none: key.isNull(), number: F.coalesce(key, F.lit(0)), h: F.xxhash64(F.col(text_col).cast("string"))})
    return tagged.join(chosen, [none, number, h], "left_semi").dropDuplicates([none, number, h]).select(docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs without near copies by fingerprints within LINK bits: of each component one row, as one_of_each chooses it. No rows: no rows."""
    return one_of_each(docs, cut(near_duplicates(docs, id_col, text_col, shingle).select("doc_id", "h", "root")), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id"))
