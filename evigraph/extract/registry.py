"""Which extractor a file gets, plugins, and extraction over tables of files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from evigraph.extract import config, generic, java, web
from evigraph.extract.model import Facts

API_VERSION = "1"


@dataclass(frozen=True)
class Plugin:
    """analyze(path, text, structure) -> more facts. Its errors become warnings of the file."""

    plugin_id: str
    extensions: tuple[str, ...]
    analyze: Callable[[str, str, Facts], Facts]
    api_version: str = API_VERSION


WEB = Plugin("web", (".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".java", ".cs", ".go", ".rs"), web.analyze)


def chosen(plugins: tuple[Plugin, ...], enabled: tuple[str, ...] = (), disabled: tuple[str, ...] = ()) -> list[Plugin]:
    """Plugins of this version by id, the first of an id, those enabled if any are named, without those disabled."""
    out: dict[str, Plugin] = {}
    for p in plugins:
        if p.api_version == API_VERSION and (not enabled or p.plugin_id in enabled) and p.plugin_id not in disabled:
            out.setdefault(p.plugin_id, p)
    return list(out.values())


def suffix_of(path: str) -> str:
    return re.search(r"(\.[^./]+)?$", path)[0].lower()


def structure(path: str, text: str) -> Facts:
    s = suffix_of(path)
    if s == ".java":
        return java.analyze(path, text)
    if s == ".sql":
        return config.analyze_sql(path, text)
    if s in (".yaml", ".yml", ".properties"):
        return config.analyze(path, text)
    return generic.analyze(path, text)


def extract(path: str, text: str, plugins: tuple[Plugin, ...] = (WEB,)) -> Facts:
    """The structure of a file and what plugins add: nodes by id, edges by key."""
    f = structure(path, text)
    for p in chosen(plugins):
        if suffix_of(path) in p.extensions:
            try:
                more = p.analyze(path, text, f)
                f.nodes |= {k: v for k, v in more.nodes.items() if k not in f.nodes}
                f.edges |= more.edges
            except Exception as e:  # a plugin's failure is the file's warning
                f.warnings.append(f"{p.plugin_id}: {type(e).__name__}: {e}")
    return f


NODE = ("node_id", "kind", "name", "qualified_name", "path", "start_line", "end_line", "metadata")
EDGE = ("source_id", "relation", "target_id", "evidence_path", "start_line", "end_line", "extractor", "confidence", "metadata")
FACT = "file string, fact string, node_id string, kind string, name string, qualified_name string, path string, source_id string, relation string, target_id string, evidence_path string, extractor string, confidence double, start_line int, end_line int, metadata string"


def facts(files: DataFrame, plugins: tuple[Plugin, ...] = (WEB,)) -> DataFrame:
    """files (path, content) -> a row for each node, edge, warning and error. A file that fails gives an error row and no other; null content counts as empty."""
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in FACT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    f = extract(path, content or "", plugins)
                    rows += [{"file": path, "fact": "node"} | n for n in f.nodes.values()]
                    rows += [{"file": path, "fact": "edge"} | e for e in f.edges.values()]
                    rows += [{"file": path, "fact": "warning", "metadata": w} for w in f.warnings]
                except Exception as e:
                    rows.append({"file": path, "fact": "error", "metadata": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, FACT)


def nodes(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'node'").select(*NODE)


def edges(found: DataFrame) -> DataFrame:
    return found.filter("fact = 'edge'").select(*EDGE)
