"""Snapshots of files, nodes, edges and chunks: merging, cascades, and publication by generation."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGE_KEY = ("source_id", "relation", "target_id", "evidence_path", "start_line")
TABLES = ("files", "nodes", "edges", "chunks", "postings", "lengths", "metrics")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", compare: tuple[str, ...] = ("size", "mtime")) -> DataFrame:
    """(key, change): added, modified or deleted; unchanged rows are left out."""
    a = old.select(key, F.struct(*compare).alias("a"))
    b = new.select(key, F.struct(*compare).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Field by field: a null path keeps the old one, lines below 1 keep the old ones, all else is the new row's. Rows of new with one id count in order of seq."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    by = W.partitionBy("node_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    keep = {"path": F.col("path"), "start_line": F.when(F.col("start_line") > 0, F.col("start_line")), "end_line": F.when(F.col("end_line") > 0, F.col("end_line"))}
    others = [c for c in old.columns if c not in keep and c != "node_id"]
    picked = [F.last(v, ignorenulls=True).over(by).alias(k) for k, v in keep.items()] + [F.last(c).over(by).alias(c) for c in others]
    last = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("seq")))
    return rows.select("node_id", *picked, last.alias("__n")).filter("__n = 1").select(old.columns)


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each key; the last written wins."""
    rows = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    n = F.row_number().over(W.partitionBy(*EDGE_KEY).orderBy(F.desc("seq")))
    return rows.withColumn("__n", n).filter("__n = 1").select(old.columns)


def delete_paths(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left once files go: their nodes and chunks, all edges at those nodes, and edges that the files give evidence for; chunks lose a symbol that is gone."""
    gone = paths.select("path").distinct()
    kept = nodes.join(gone, "path", "left_anti")
    ids = kept.select("node_id")
    left = edges.join(gone, F.col("evidence_path") == F.col("path"), "left_anti")
    left = left.join(ids, F.col("source_id") == F.col("node_id"), "left_semi").join(ids, F.col("target_id") == F.col("node_id"), "left_semi")
    rest = chunks.join(gone, "path", "left_anti").join(ids.select(F.col("node_id").alias("symbol_id"), F.lit(True).alias("__there")), "symbol_id", "left")
    return kept, left, rest.withColumn("symbol_id", F.when(F.col("__there"), F.col("symbol_id"))).select(chunks.columns)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("node_id")
    return edges.join(ids, F.col("source_id") == F.col("node_id"), "left_anti").union(edges.join(ids, F.col("target_id") == F.col("node_id"), "left_anti")).distinct()


def of_layer(column: str) -> Column:
    """Is the path that of a layer, as @derived or @persona, not that of a file?"""
    return F.startswith(F.coalesce(column, F.lit("")), F.lit("@"))


def replace_layer(edges: DataFrame, layer: str, new: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """edges with a layer's rows, or those of some owners (evidence_path), given anew."""
    own = F.startswith("evidence_path", F.lit(layer))
    if owners is None:
        return edges.filter(~own).unionByName(new)
    return edges.join(owners.select("evidence_path").distinct(), "evidence_path", "left_anti").select(edges.columns).unionByName(new)


class IndexCompatibilityError(RuntimeError):
    """The store was written by another version."""


class Store:
    """Generations below a path that Spark can write: gen=N/<table>. A reader pins the generation that the manifest names.

    Writers publish a new generation and then replace the manifest by a rename, so a reader sees the old or the new one. A batch that
    leaves edges without nodes isn't published."""

    VERSION = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        jvm, fs = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json")):
            return {"version": self.VERSION, "generation": 0, "metadata": {}}
        m = json.loads(self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).first()[0])
        if m["version"] != self.VERSION:
            raise IndexCompatibilityError(f"version {m['version']}")
        return m

    def _put(self, manifest: dict) -> None:
        jvm, fs = self._fs()
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        out = fs.create(at("manifest.tmp"), True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(at("manifest.tmp"), at("manifest.json"), options)

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        n = self.manifest()["generation"] if generation is None else generation
        return self.spark.read.parquet(f"{self.path}/gen={n}/{table}")

    def publish(self, tables: dict[str, DataFrame], metadata: dict | None = None) -> int:
        """Writes a generation; tables that aren't given are carried over, but for postings of chunks that are. Returns its number."""
        m = self.manifest()
        n = m["generation"] + 1
        carried = set(m.get("tables", [])) - ({"postings", "lengths"} if "chunks" in tables else set())
        whole = {t: tables[t] if t in tables else self.read(t) for t in TABLES if t in tables or t in carried}
        if "edges" in whole and "nodes" in whole and not dangling(whole["edges"], whole["nodes"]).isEmpty():
            raise ValueError("edges without nodes")
        for t, df in whole.items():
            sort = [c for c in ("tok", "name_normalized", "source_id", "path") if c in df.columns][:1]
            if sort == ["tok"]:  # a word's rows lie together; those of a frequent one are split by document
                df, sort = df.repartitionByRange("tok", "doc"), ["tok", "doc"]
            (df.sortWithinPartitions(*sort) if sort else df).write.mode("overwrite").parquet(f"{self.path}/gen={n}/{t}")
        self._put({"version": self.VERSION, "generation": n, "tables": sorted(whole), "metadata": m["metadata"] | (metadata or {})})
        return n

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df, written beside the next generation and read again: plans that build on it stay short, and survive lost executors."""
        at = f"{self.path}/stage={self.manifest()['generation'] + 1}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def clear_stages(self) -> None:
        jvm, fs = self._fs()
        for k in range(self.manifest()["generation"] + 2):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/stage={k}"), True)

    def set_metadata(self, **values) -> None:
        m = self.manifest()
        self._put(m | {"metadata": m["metadata"] | values})

    def append_metric(self, row: DataFrame) -> None:
        row.write.mode("append").parquet(f"{self.path}/metrics")

    def on_generation(self, build: Callable[[int], object], cache: dict) -> object:
        """What build makes of the current generation, made once for each."""
        n = self.manifest()["generation"]
        if n not in cache:
            cache.clear()
            cache[n] = build(n)
        return cache[n]
