"""Evaluation datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

CASE = "id string, query string, expected_persona string, expected_files array<string>, expected_symbols array<string>, expected_context_types array<string>, forbidden_files array<string>, profile string"
CONTEXT_TYPES = ("source", "test", "configuration", "database", "documentation")
FIELDS = tuple(x.split()[0] for x in CASE.split(", "))
TOP = {"schema_version", "name", "cases", "benchmark", "thresholds"}


class DatasetError(ValueError):
    """A dataset of another version or shape."""


def parse(text: str, suffix: str = ".json") -> dict:
    """JSON, or YAML if a reader is installed; a bare list of cases is version 1. Unknown fields and types are refused."""
    if suffix in (".yaml", ".yml"):
        import yaml

        raw = yaml.safe_load(text)
    else:
        raw = json.loads(text)
    raw = {"schema_version": 1, "name": "cases", "cases": raw} if isinstance(raw, list) else raw
    if raw.get("schema_version") != 1:
        raise DatasetError(f"version {raw.get('schema_version')}")
    if unknown := set(raw) - TOP:
        raise DatasetError(f"unknown {sorted(unknown)}")
    for c in raw["cases"]:
        if unknown := set(c) - set(FIELDS):
            raise DatasetError(f"unknown {sorted(unknown)}")
        if bad := set(c.get("expected_context_types", [])) - set(CONTEXT_TYPES):
            raise DatasetError(f"context types {sorted(bad)}")
    return raw


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a dataset as rows."""
    text = spark.read.text(path, wholetext=True).first()[0]
    data = parse(text, "." + path.rsplit(".", 1)[-1])
    lists = {f for f, t in (x.split() for x in CASE.split(", ")) if t.startswith("array")}
    return spark.createDataFrame([tuple(c.get(f, [] if f in lists else None) for f in FIELDS) for c in data["cases"]], CASE)


def schema() -> dict:
    """A JSON schema of datasets."""
    case = {f: {"type": "array", "items": {"type": "string"}} if t.startswith("array") else {"type": "string"} for f, t in (x.split() for x in CASE.split(", "))}
    return {"type": "object", "additionalProperties": False, "required": ["schema_version", "cases"], "properties": {"schema_version": {"const": 1}, "name": {"type": "string"}, "cases": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["id", "query"], "properties": case}}, "benchmark": {"type": "object"}, "thresholds": {"type": "object"}}}


def registry(spark: SparkSession, projects: dict[str, str], table: str) -> DataFrame | None:
    """A table of several snapshots, with the project that each row is from. Projects that can't be read are left out."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    out = None
    for name, path in projects.items():
        try:
            rows = spark.read.parquet(f"{path}/{table}").withColumn("project", F.lit(name))
        except AnalysisException:
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
