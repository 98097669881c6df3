"""Line windows and heading sections of texts, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.functions.text import heading_tags

LINES, OVERLAP = 80, 12
#: A heading. Fixed value.
HEADING = r"^#{1,6}\s+\S"


def lines_of(text: Column) -> Column:
    """A final line break starts no line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def window_starts(first: Column, last: Column, size: int = LINES, overlap: int = OVERLAP) -> Column:
    """First lines of windows of `size` lines, the next `overlap` lines before the end of the one before, until one reaches the last line."""
    stride = max(1, size - overlap)
    count = F.greatest(F.lit(0), F.ceil((last - first + 1 - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda k: first + k * stride)


def line_windows(files: DataFrame, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """files (path, language, content) -> (path, language, start_line, end_line, content). Empty texts give no chunk."""
    rows = files.filter("content <> ''").select("path", "language", lines_of(F.col("content")).alias("lines"))
    each = rows.select("path", "language", "lines", F.explode(window_starts(F.lit(1), F.size("lines"), size, overlap)).alias("start_line"))
    end = F.least(F.col("start_line") + size - 1, F.size("lines"))
    return each.select("path", "language", F.col("start_line").cast("int"), end.cast("int").alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), F.lit(size)), "\n").alias("content"))


def uncovered_windows(files: DataFrame, covered: DataFrame, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Windows of the file that hold a line that no range of covered (path, start_line, end_line) has, from the first to the last such line."""
    taken = covered.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct()
    windows = line_windows(files, size, overlap).select("path", F.col("start_line").alias("w_start"), F.explode(F.sequence("start_line", "end_line")).alias("line"))
    free = windows.join(taken, ["path", "line"], "left_anti")
    return free.groupBy("path", "w_start").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("w_start").distinct()


def symbol_windows(symbols: DataFrame, counts: DataFrame, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """symbols (path, symbol_id, kind, name, start_line, end_line) and counts (path, n) -> windows of each symbol; equal ranges become one, which the first symbol owns and all tag."""
    rows = symbols.join(counts, "path").withColumns({"first": F.greatest(F.lit(1), "start_line"), "last": F.least("n", "end_line")}).filter("first <= last")
    each = rows.select("path", "symbol_id", "kind", "name", "last", F.explode(window_starts(F.col("first"), F.col("last"), size, overlap)).alias("start_line"))
    each = each.withColumn("end_line", F.least(F.col("start_line") + size - 1, F.col("last")))
    merged = each.groupBy("path", "start_line", "end_line").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "kind", "name"))).alias("s"))
    return merged.select("path", "start_line", "end_line", F.col("s")[0]["symbol_id"].alias("symbol_id"), F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["kind"], x["name"])))).alias("tags"))


def heading_sections(files: DataFrame, heading: str = HEADING) -> DataFrame:
    """(path, start_line, end_line, tags): from each heading to the next. Without a heading the file is one section; with one, what stands before it is dropped."""
    rows = files.filter("content <> ''").select("path", F.posexplode(lines_of(F.col("content"))).alias("pos", "text"))
    marked = rows.select("path", (F.col("pos") + 1).alias("line"), "text", F.rlike("text", F.lit(heading)).alias("is_heading"))
    by_line = W.partitionBy("path").orderBy("line")
    numbered = marked.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(by_line)).withColumn("any", F.max("is_heading").over(W.partitionBy("path")))
    kept = numbered.filter(~F.col("any") | (F.col("section") > 0))
    out = kept.groupBy("path", "section").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"))
    return out.select("path", "start_line", "end_line", F.concat(F.array(F.lit("markdown")), F.coalesce(heading_tags(F.col("heading")), F.array().cast("array<string>"))).alias("tags"))


def build_chunks(files: DataFrame, symbols: DataFrame, tags: DataFrame, size: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """files (path, language, content), symbols (path, symbol_id, kind, name, start_line, end_line), tags (path, tags) -> chunks.

    Markdown is cut at headings, then in windows; other files by symbols, then what they leave. Tags of the file come first."""
    plain, marked = files.filter("language <> 'markdown'"), files.filter("language = 'markdown'")
    counts = plain.filter("content <> ''").select("path", F.size(lines_of(F.col("content"))).alias("n"))
    own = symbol_windows(symbols.join(plain.select("path"), "path", "left_semi"), counts, size, overlap)
    rest = uncovered_windows(plain, own.select("path", "start_line", "end_line"), size, overlap)
    sections = heading_sections(marked)
    windows = sections.select("path", "tags", "end_line", F.explode(window_starts(F.col("start_line"), F.col("end_line"), size, overlap)).alias("start_line"))
    cut = windows.select("path", "start_line", F.least(F.col("start_line") + size - 1, "end_line").alias("end_line"), F.lit(None).cast("string").alias("symbol_id"), "tags")
    none = F.array().cast("array<string>")
    whole = own.union(rest.select("path", "start_line", "end_line", F.lit(None).cast("string"), none)).union(cut)
    texts = files.select("path", "language", lines_of(F.col("content")).alias("lines"))
    joined = whole.join(texts, "path").join(tags.withColumnRenamed("tags", "file_tags"), "path", "left")
    content = F.array_join(F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    key = F.sha2(F.concat_ws("\x1f", "path", F.col("start_line").cast("string"), F.col("end_line").cast("string")), 256)
    return joined.select(
        F.concat(F.lit("chunk::"), F.substring(key, 1, 20)).alias("chunk_id"), "path", F.col("start_line").cast("int"), F.col("end_line").cast("int"), content.alias("content"), F.sha2(content, 256).alias("content_hash"),
        "symbol_id", "language", F.array_distinct(F.concat(F.coalesce("file_tags", none), "tags")).alias("tags"),
    )
