"""Document fingerprints: threshold-scaled sketches, by built-in functions only.

A sketch keeps the hash of every five-word shingle of a text that is below a fixed fraction of all hashes, so texts of very
unequal length compare under one threshold, and the sketch of two texts together is the union of theirs. A text of few
words has too few such hashes to be told by: it also keeps, whole, the hashes of its two-word shingles, by which texts of few
words are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.common import table

SHINGLE = 5
#: One hash of so many is kept.
SCALE = 4
#: Texts of fewer than FEW words keep all shingles of FINE words as well.
FEW, FINE = 40, 2
#: Followers are looked up within blocks of ascending ids: this many quantile ranges, each cut evenly into blocks of about so many rows.
RANGES, ROWS = 256, 20_000
#: Up to so many blocks, the table of their first ids (two longs each) is sent to all tasks; beyond, it is joined by a shuffle.
SENT = 1_000_000
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, then) -> Column:
    """then(value), where value is evaluated once."""
    return F.transform(F.array(value), then)[0]


def runs(words: Column, shingle: int) -> Column:
    """The xxhash64 of each run of `shingle` words; of all words where there are fewer; none without a word."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - shingle), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    return F.when(F.size(words) >= shingle, each).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def limit(scale: int = SCALE) -> int:
    """Signed hashes below this are kept: the lowest of `scale` equal parts."""
    return -(1 << 63) + (1 << 64) // scale


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE, few: int = FEW, fine: int = FINE) -> Column:
    """A struct of two ascending arrays of distinct hashes: low (those below the limit) and fine (all of a text of few words, else none). Null counts as empty."""
    words = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    ordered = lambda a: F.array_sort(F.array_distinct(a))
    return let(words, lambda w: F.struct(ordered(F.filter(runs(w, shingle), lambda x: x < F.lit(limit(scale)))).alias("low"), F.when(F.size(w) < few, ordered(runs(w, fine))).otherwise(F.array().cast("array<bigint>")).alias("fine")))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the shingles of both: low hashes of both, and fine ones if both have some."""
    both = (F.size(a["fine"]) > 0) & (F.size(b["fine"]) > 0)
    return F.struct(F.array_sort(F.array_union(a["low"], b["low"])).alias("low"), F.when(both, F.array_sort(F.array_union(a["fine"], b["fine"]))).otherwise(F.array().cast("array<bigint>")).alias("fine"))


def _within(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has too: by fine hashes if both have some, else by low ones. 1 if both are empty, 0 if only one is, or has no low hash."""
    nothing = lambda x: (F.size(x["low"]) == 0) & (F.size(x["fine"]) == 0)
    fine = (F.size(a["fine"]) > 0) & (F.size(b["fine"]) > 0)
    return F.when(nothing(a) & nothing(b), F.lit(1.0)).when(fine, _within(a["fine"], b["fine"])).otherwise(_within(a["low"], b["low"]))


def likeness(a: Column, b: Column) -> Column:
    """The larger of the two containments: 1 where one text lies within the other."""
    return F.greatest(containment(a, b), containment(b, a))


def hexed(a: Column) -> Column:
    """16 digits a hash; a point before the fine ones."""
    digits = lambda x: F.array_join(F.transform(x, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")
    return F.concat(digits(a["low"]), F.when(F.size(a["fine"]) > 0, F.concat(F.lit("."), digits(a["fine"]))).otherwise(F.lit("")))


def blocks(rows: DataFrame, by: str) -> tuple[Column, int]:
    """A number that doesn't fall as `by` grows; null comes first. And how many values it has at most, which grows with the rows."""
    low, high, n = rows.agg(F.min(by), F.max(by), F.count(by)).first()
    if not n or low == high:
        return F.when(F.col(by).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"), 2
    inner = rows.stat.approxQuantile(by, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)
    edges = sorted({low, *(int(x) for x in inner if low < int(x) <= high), high + 1 if high < (1 << 63) - 1 else high})
    parts = max(1, -(-n // ((len(edges) - 1) * ROWS)))
    at = F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges[:-1]]), lambda e: e <= F.col(by))))
    start, width = (F.element_at(F.array(*[F.lit(float(v)) for v in values]), at) for values in (edges[:-1], [b - a for a, b in zip(edges, edges[1:], strict=False)]))
    within = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col(by) - start) * parts / width)))
    return F.when(F.col(by).isNull(), F.lit(-1)).otherwise(at * parts + within).cast("long"), len(edges) * parts + 1


def followers(rows: DataFrame, by: str, text: str, more: dict[str, Column]) -> DataFrame:
    """rows and the columns `more`, with, as next_<c>, the text and `more` of the row that follows in ascending order of `by` (null first); the first follows the last.

    A window within each block finds the follower. The last row of a block is followed by the first of the next block
    that has rows; only those firsts are looked up once more. Rows with equal `by` go in the order of their texts, which
    mustn't be null."""
    block, most = blocks(rows, by)
    dealt = rows.withColumn("__block", block)
    order = W.partitionBy("__block").orderBy(F.col(by).asc_nulls_first(), text)
    carried = [text, *more]
    found = dealt.withColumns(more).withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    around = W.orderBy("__block")
    starts = dealt.groupBy("__block").agg(F.min(by).alias("__id")).select(F.coalesce(F.lag("__block").over(around), F.max("__block").over(W.partitionBy())).alias("__to"), F.col("__id"))
    starts = F.broadcast(starts) if most <= SENT else starts
    first = rows.join(starts, rows[by].eqNullSafe(starts["__id"])).groupBy("__to").agg(F.min(text).alias(text)).withColumns(more)
    first = first.select("__to", *[F.col(c).alias(f"__{c}") for c in carried])
    joined = found.join(first, found["__block"] == first["__to"], "left")
    last = F.col(f"next_{text}").isNull()
    return joined.select(*rows.columns, *more, *[F.when(last, F.col(f"__{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in carried])


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each row's text, and its likeness to that of its edited text and of the next row's text.

    Edited: the last floor(n_chars / 4) code points give way to the first as many of the next row by ascending id; after the last
    comes the first, so a lone row follows itself. Null and empty texts have an empty fingerprint. Repeated ids follow
    each other in the order of their texts; null ids come first; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    found = followers(rows, "doc_id", "text", {"sketch": sketch(F.col("text"))}).withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hexed(F.col("sketch")).alias("fingerprint"), hexed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
