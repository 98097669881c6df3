"""A file that lists the projects with an index, and their tables as one."""

from __future__ import annotations

import datetime
import hashlib
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.sources.store import IndexCompatibilityError, Store

VERSION = 1


def project_id(root: str) -> str:
    return "project::" + hashlib.blake2b(root.casefold().encode(), digest_size=10).hexdigest()


class Projects:
    """Entries {id, root, index, added_at} in a JSON file, which a rename replaces."""

    def __init__(self, path: str):
        self.path = path

    def all(self) -> list[dict]:
        """By the folder's name; entries without a root or an index are passed over."""
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            raw = json.load(f)
        if not isinstance(raw, dict) or raw.get("schema_version") != VERSION:
            raise ValueError(f"{self.path} is of another version")
        whole = [x for x in raw.get("projects", []) if isinstance(x, dict) and {"id", "root", "index"} <= x.keys()]
        return sorted(whole, key=lambda x: (os.path.basename(x["root"]).casefold(), x["root"]))

    def _write(self, entries: list[dict]) -> None:
        with open(f"{self.path}.tmp", "w") as f:
            json.dump({"schema_version": VERSION, "projects": entries}, f, indent=2)
        os.replace(f"{self.path}.tmp", self.path)

    def add(self, root: str, index: str) -> dict:
        """Adds a project, or gives a known one another index; the time at which it was first added stays."""
        root = os.path.realpath(os.path.expanduser(root))
        if not os.path.isdir(root):
            raise ValueError(f"{root} is no folder")
        known = {x["id"]: x for x in self.all()}
        entry = {"id": project_id(root), "root": root, "index": index, "added_at": datetime.datetime.now(datetime.UTC).isoformat()}
        entry["added_at"] = known.get(entry["id"], entry).get("added_at", "")
        self._write(list((known | {entry["id"]: entry}).values()))
        return entry

    def remove(self, project: str) -> bool:
        entries = self.all()
        left = [x for x in entries if x["id"] != project]
        if len(left) < len(entries):
            self._write(left)
        return len(left) < len(entries)

    def indexes(self) -> dict[str, str]:
        return {x["id"]: x["index"] for x in self.all()}

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """A table of all projects' current generations, with the project of each row; projects that can't be read are left out."""
        out = None
        for project, path in self.indexes().items():
            try:
                rows = Store(spark, path).read(table).withColumn("project", F.lit(project))
            except (AnalysisException, IndexCompatibilityError):
                continue
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out
