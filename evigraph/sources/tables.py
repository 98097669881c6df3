"""The property graph, the files and the metric log that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed confidences of the relations between tables.
CONFIDENCE = {"CONTAINS": 1.0, "CALLS": 0.72, "DEPENDS_ON": 0.9, "IMPLEMENTS": 0.96}


#: Tables whose rows are long texts; up to so many bytes for each core they are small.
TEXTS, SMALL = ("documents", "pages", "conversations"), 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table in fewer files than there are cores, dealt over the cores: a small file is one row group, which one task would read. Other tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores or int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * SMALL:
        return rows
    return rows.repartition(cores)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, kind, name, qualified_name, path): regions, nations, customers, suppliers, parts and orders."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    key = lambda c: F.col(c).cast("string")
    rows = [
        t("region").select(text("region::", key("r_regionkey")), F.lit("region"), F.col("r_name"), F.col("r_name"), text("region/", F.col("r_name"))),
        nation.select(text("nation::", key("n_nationkey")), F.lit("nation"), F.col("n_name"), text(F.col("r_name"), ".", F.col("n_name")), text("region/", F.col("r_name"), "/", F.col("n_name"))),
        t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(text("customer::", key("c_custkey")), F.lit("customer"), F.col("c_name"), text(F.col("n_name"), ".", F.col("c_name")), text("customer/", key("c_custkey"))),
        t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(text("supplier::", key("s_suppkey")), F.lit("supplier"), F.col("s_name"), text(F.col("n_name"), ".", F.col("s_name")), text("supplier/", key("s_suppkey"))),
        t("part").select(text("part::", key("p_partkey")), F.lit("part"), F.col("p_name"), text(F.col("p_brand"), ".", F.col("p_name")), text("part/", key("p_partkey"))),
        t("orders").select(text("order::", key("o_orderkey")), F.lit("order"), text("Order#", key("o_orderkey")), text("customer", key("o_custkey"), ".Order#", key("o_orderkey")), text("orders/", key("o_orderkey"))),
    ]
    out = rows[0].toDF("node_id", "kind", "name", "qualified_name", "path")
    for r in rows[1:]:
        out = out.union(r)
    return out


NODES_SQL = """nodes as (
  select 'region::' || r_regionkey as node_id, 'region' as kind, r_name as name, r_name as qualified_name, 'region/' || r_name as path from region
  union all select 'nation::' || n_nationkey, 'nation', n_name, r_name || '.' || n_name, 'region/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
  union all select 'customer::' || c_custkey, 'customer', c_name, n_name || '.' || c_name, 'customer/' || c_custkey from customer join nation on c_nationkey = n_nationkey
  union all select 'supplier::' || s_suppkey, 'supplier', s_name, n_name || '.' || s_name, 'supplier/' || s_suppkey from supplier join nation on s_nationkey = n_nationkey
  union all select 'part::' || p_partkey, 'part', p_name, p_brand || '.' || p_name, 'part/' || p_partkey from part
  union all select 'order::' || o_orderkey, 'order', 'Order#' || o_orderkey, 'customer' || o_custkey || '.Order#' || o_orderkey, 'orders/' || o_orderkey from orders
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, relation, target_id, evidence_path, start_line, end_line, confidence), one for each pair and relation."""
    t = lambda n: table(spark, sf_dir, n)
    ident = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))

    def edge(df: DataFrame, source: tuple, relation: str, target: tuple, path: str, line: str) -> DataFrame:
        rows = df.select(ident(*source).alias("source_id"), F.lit(relation).alias("relation"), ident(*target).alias("target_id"), F.lit(path).alias("evidence_path"), F.col(line).cast("int").alias("line"))
        rows = rows.groupBy("source_id", "relation", "target_id", "evidence_path").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")) if path == "lineitem" else rows.select("*", F.col("line").alias("start_line"), F.col("line").alias("end_line")).drop("line")
        return rows.withColumn("confidence", F.lit(CONFIDENCE[relation]))

    parts = [
        edge(t("nation"), ("region", "n_regionkey"), "CONTAINS", ("nation", "n_nationkey"), "nation", "n_nationkey"),
        edge(t("customer"), ("nation", "c_nationkey"), "CONTAINS", ("customer", "c_custkey"), "customer", "c_custkey"),
        edge(t("supplier"), ("nation", "s_nationkey"), "CONTAINS", ("supplier", "s_suppkey"), "supplier", "s_suppkey"),
        edge(t("orders"), ("customer", "o_custkey"), "CALLS", ("order", "o_orderkey"), "orders", "o_orderkey"),
        edge(t("lineitem"), ("order", "l_orderkey"), "DEPENDS_ON", ("part", "l_partkey"), "lineitem", "l_linenumber"),
        edge(t("lineitem"), ("supplier", "l_suppkey"), "IMPLEMENTS", ("part", "l_partkey"), "lineitem", "l_linenumber"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p.select(out.columns))
    return out


EDGES_SQL = """edges as (
  select 'region::' || n_regionkey as source_id, 'CONTAINS' as relation, 'nation::' || n_nationkey as target_id, 'nation' as evidence_path, n_nationkey::int as start_line, n_nationkey::int as end_line, 1.0::double as confidence from nation
  union all select 'nation::' || c_nationkey, 'CONTAINS', 'customer::' || c_custkey, 'customer', c_custkey::int, c_custkey::int, 1.0 from customer
  union all select 'nation::' || s_nationkey, 'CONTAINS', 'supplier::' || s_suppkey, 'supplier', s_suppkey::int, s_suppkey::int, 1.0 from supplier
  union all select 'customer::' || o_custkey, 'CALLS', 'order::' || o_orderkey, 'orders', o_orderkey::int, o_orderkey::int, 0.72 from orders
  union all select 'order::' || l_orderkey, 'DEPENDS_ON', 'part::' || l_partkey, 'lineitem', min(l_linenumber)::int, max(l_linenumber)::int, 0.9 from lineitem group by l_orderkey, l_partkey
  union all select 'supplier::' || l_suppkey, 'IMPLEMENTS', 'part::' || l_partkey, 'lineitem', min(l_linenumber)::int, max(l_linenumber)::int, 0.96 from lineitem group by l_suppkey, l_partkey
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (path, language, content, size_bytes)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))


FILES_SQL = """files as (select source || '/' || doc_id as path, lang as language, coalesce(text, '') as content, strlen(coalesce(text, ''))::bigint as size_bytes from documents)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric log: (id, created_at, operation, repository, duration_ms, k)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "context").otherwise(F.col("event_type")).alias("operation"), (F.col("user_id") % 7).alias("repository"), F.col("value").alias("duration_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"))


METRICS_SQL = """metrics as (select event_id as id, ts as created_at, case when event_type = 'view' then 'context' else event_type end as operation, user_id % 7 as repository, value as duration_ms, (props->>'$.k')::bigint as k from events)"""
