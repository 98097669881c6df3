"""Keys of YAML and properties files, the environment variables in their values, and tables in SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from evigraph.extract.model import Facts

ENVIRONMENT = re.compile(r"\$\{([A-Za-z_]\w*)(?::[^}]*)?\}")
PAIR = re.compile(r"([ \t]*)([\w.-]+)[ \t]*:(?:[ \t]+(.*))?$")
TABLE = re.compile(r"\b(?:create\s+table(?:\s+if\s+not\s+exists)?|alter\s+table|insert\s+into|references)\s+([A-Za-z_][\w.$\"]*)", re.I)


def properties(text: str) -> Iterator[tuple[int, str, str]]:
    for n, line in enumerate(text.splitlines(), 1):
        key, sign, value = line.partition("=")
        if sign and line.strip()[:1] not in ("#", "!"):
            yield n, key.strip(), value.strip()


def yaml(text: str) -> Iterator[tuple[int, str, str]]:
    """Keys with those above them; comments and list items are left out."""
    above: list[tuple[int, str]] = []
    for n, line in enumerate(text.splitlines(), 1):
        m = PAIR.match(line.rstrip())
        if not m or line.lstrip().startswith(("#", "- ")):
            continue
        depth, value = len(m[1].expandtabs(4)), (m[3] or "").strip()
        above = [a for a in above if a[0] < depth]
        yield n, ".".join([*(k for _, k in above), m[2]]), value
        if not value:
            above.append((depth, m[2]))


def analyze(path: str, text: str) -> Facts:
    f = Facts(path, text, "config-structure")
    root = f.file()
    for n, key, value in properties(text) if path.lower().endswith(".properties") else yaml(text):
        node = f.node(f"config::{key}", "configuration_key", key.rsplit(".", 1)[-1], key, n, n, value_preview=value[:120])
        f.edge(root, "DEFINES", node, n)
        for name in ENVIRONMENT.findall(value):
            f.edge(node, "BINDS_ENV", f.node(f"env::{name}", "environment_variable", name, name, placed=False), n)
    return f


def analyze_sql(path: str, text: str) -> Facts:
    f = Facts(path, text, "sql-structure")
    root = f.file("migration")
    for m in TABLE.finditer(text):
        name = m[1].replace('"', "")
        f.edge(root, "TOUCHES_TABLE", f.node(f"table::{name.lower()}", "database_table", name.rsplit(".", 1)[-1], name, placed=False), f.line(m.start()))
    return f
