"""Queries on extraction, over files in the package and over the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.extract import registry
from evigraph.operators import chunking, resolve
from evigraph.plans import expected
from evigraph.plans.common import literal_rows, query
from evigraph.plans.fixtures import FILES
from evigraph.sources.tables import table


def facts(spark, *suffixes):
    rows = [(p, t) for p, t in FILES.items() if p.endswith(suffixes or tuple(FILES))]
    return registry.facts(literal_rows(spark, rows, "path string, content string"))


def edge_rows(found):
    return registry.edges(found).select("source_id", "relation", "target_id", "evidence_path", "start_line", "confidence")


@query(expected.sql(expected.JAVA_EXTRACT))
def java_extract(spark, d):
    return edge_rows(facts(spark, ".java"))


@query(expected.sql(expected.GENERIC_EXTRACT))
def generic_extract(spark, d):
    return registry.nodes(facts(spark, ".py", ".ts", ".go")).filter("path is not null").select("node_id", "kind", "qualified_name", "start_line")


@query(expected.sql(expected.CONFIG_EXTRACT))
def config_extract(spark, d):
    return edge_rows(facts(spark, ".yml", ".properties"))


@query(expected.sql(expected.WEB_CONTRACTS))
def web_contracts(spark, d):
    return edge_rows(facts(spark)).filter("relation in ('EXPOSES_ENDPOINT', 'CALLS_ENDPOINT')")


@query(expected.sql(expected.RESOLVED_FIXTURE))
def resolved_fixture(spark, d):
    found = facts(spark)
    return resolve.derived_edges(registry.edges(found), registry.nodes(found).dropDuplicates(["node_id"])).select("source_id", "relation", "target_id", "confidence")


@query(expected.sql(expected.SYMBOL_WINDOWS))
def symbol_windows(spark, d):
    found = facts(spark, ".java", ".py")
    symbols = registry.nodes(found).filter("path is not null and kind in ('class', 'method')").select("path", F.col("node_id").alias("symbol_id"), "kind", "name", "start_line", "end_line")
    counts = literal_rows(spark, [(p, len(t.splitlines())) for p, t in FILES.items()], "path string, n int")
    return chunking.symbol_windows(symbols, counts, 6, 2).select("path", "start_line", "end_line", "symbol_id", F.array_join("tags", ",").alias("tags"))


SQL_TABLES = r"""with w as (select page_id, unnest(regexp_extract_all(html, '(?i)\b(?:create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table|insert\s+into|references|href)[\s=]+"?([A-Za-z_/][\w.$/]*)', 1)) as name from pages) select page_id, lower(name) as name, count(*) as n from w group by page_id, lower(name)"""


@query(SQL_TABLES)
def table_mentions(spark, d):
    """Tables and targets that pages name: the SQL extractor's shape, natively."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)\b(?:create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table|insert\s+into|references|href)[\s=]+"?([A-Za-z_/][\w.$/]*)'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("name")).groupBy("page_id", F.lower("name").alias("name")).agg(F.count("*").alias("n"))


PROPERTIES = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, regexp_extract(line, '([A-Za-z0-9_.]+)\s*=\s*("[^"]*")', 1) as key, count(*) as n from l where regexp_matches(line, '([A-Za-z0-9_.]+)\s*=\s*("[^"]*")') group by 1, 2"""


@query(PROPERTIES)
def assignments(spark, d):
    """key = "value" lines of documents, natively."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    pattern = r'([A-Za-z0-9_.]+)\s*=\s*("[^"]*")'
    return lines.filter(F.rlike("line", F.lit(pattern))).groupBy("doc_id", F.regexp_extract("line", pattern, 1).alias("key")).agg(F.count("*").alias("n"))
