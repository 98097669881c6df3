"""Mixing sources to target weights by systematic sampling.

A source's documents stand in a fixed order; each is expected target / size copies, so the prefix sum after rank k is
k times that rate. With one offset in [0, 1) added, a document is taken once for each integer that its step crosses.
Sorting by size class first makes the words that are taken follow the documents that are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.common import WORD, cut, dealt, table

WEIGHTS = (5, 2, 1)
PERCENT = 150
MOST = 2
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """sizes (source, source_size), a row a source -> with target.

    Sources by code point, null last, weigh `weights`, repeating. They share percent % of all sizes by weight; none gets
    over `most` times its size, and the excess is shared again by weight. That ends where a level x exists with each target the
    lesser of x times the weight and the cap: in order of cap / weight, the first sources are capped as long as
    their cap is within the level that the others would share."""
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = (
        sizes.withColumn("weight", weigh)
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(W.partitionBy()) * (percent / 100))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    # the first source that isn't capped sets the level; among equal ratios it has the highest
    free = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", (-F.col("level")).alias("down")))).over(W.partitionBy())
    return rows.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("free").isNull() | (F.col("ratio") < F.col("free.ratio")), F.col("cap")).otherwise(F.least("cap", -F.col("free.down") * F.col("weight"))).alias("target")
    )


def size_class(size: Column) -> Column:
    """An integer that grows with the size: its bits, and the two after the first."""
    bits = F.length(F.bin(size))
    return bits * 4 + F.when(bits >= 3, (size / F.pow(F.lit(2.0), bits - 3)).cast("long") - 4).otherwise(F.lit(0))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, most: int = MOST, percent: int = PERCENT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs.

    size: words of the text, null counts as 0. The order within a source: size class, first two hex digits of the id's md5, size,
    id. Ranks come from counts of (source, class, digits) and a window within those blocks, so no task holds a source.
    Null sources form one source, the last. Null ids sort first. Repeated rows are ranked one after the other in any
    order, which changes nothing, as they are equal. A source of size 0 has target 0 and is not taken. An empty
    table gives no rows. Other columns are ignored."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    ).withColumns({"class": size_class(F.col("size")), "digits": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2)})
    rows = cut(dealt(rows))  # a few numbers a row, so that the texts are read once
    block = ["source", "class", "digits"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    start = counts.select(*block, F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("class", "digits").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))), 1, 5), 16, 10).cast("double") / (1 << 20)
    rated = targets(sizes, weights, percent, most).select("source", "source_size", "target", F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)).alias("rate"), offset.alias("offset"))
    same = lambda a, b, names: F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))
    blocks = start.alias("s").join(rated.alias("t"), same("s", "t", ["source"])).select("s.*", "source_size", "target", "rate", "offset")
    ranked = rows.withColumn("within", F.row_number().over(W.partitionBy(*block).orderBy("size", "doc_id")))
    joined = ranked.alias("r").join(blocks.alias("b"), same("r", "b", block))
    rank = F.col("before") + F.col("within")
    copies = F.floor(F.col("offset") + F.col("rate") * rank) - F.floor(F.col("offset") + F.col("rate") * (rank - 1))
    return joined.select("r.doc_id", "r.source", "r.size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of docs, each as often as it is drawn. Rows that share an id count as one document: each is repeated as often as the one that is drawn most."""
    drawn = draw(docs, id_col, text_col, source_col, **how).groupBy("doc_id").agg(F.max("copies").alias("__copies")).withColumnRenamed("doc_id", "__id")
    times = docs.join(drawn, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))).filter("__copies > 0")
    return times.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), c as (
  select *, length(bin(size)) * 4 + case when length(bin(size)) >= 3 then (size >> (length(bin(size)) - 3)) - 4 else 0 end as class,
    substr(md5(coalesce(doc_id::varchar, '')), 1, 2) as digits from d
), r as (
  select *, row_number() over (partition by source order by class, digits, size, doc_id nulls first) as rank from c
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as number from d group by source
), w as (
  select *, case number % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), q as (
  select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as ratio, sum(source_size::double) over () * 1.5::double as total from w
), v as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from q
), f as (
  select ratio, level from v where ratio > level order by ratio, level desc limit 1
), t as (
  select source, source_size, case when f.ratio is null or v.ratio < f.ratio then cap else least(cap, f.level * weight) end as target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 5))::bigint / 1048576.0::double as off from v left join f on true
)
select r.doc_id, r.size, t.source_size, t.target,
  ((floor(off + coalesce(target / nullif(source_size, 0), 0) * rank) - floor(off + coalesce(target / nullif(source_size, 0), 0) * (rank - 1))) * size)::bigint as taken
from r join t on r.source is not distinct from t.source
"""
