"""What extractors return, and helpers that they share."""

from __future__ import annotations

import bisect
import json
import re
from dataclasses import dataclass, field


@dataclass
class Facts:
    """Nodes by id, the last of an id wins; edges in order, one for each key."""

    path: str
    text: str
    extractor: str
    nodes: dict[str, dict] = field(default_factory=dict)
    edges: dict[tuple, dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._breaks = [m.start() for m in re.finditer("\n", self.text)]
        self.n_lines = max(1, len(self.text.splitlines()))

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self._breaks, offset) + 1

    def node(self, node_id: str, kind: str, name: str, qualified: str, start: int = 0, end: int = 0, placed: bool = True, **metadata) -> str:
        self.nodes[node_id] = {"node_id": node_id, "kind": kind, "name": name, "qualified_name": qualified, "path": self.path if placed else None, "start_line": start, "end_line": end, "metadata": json.dumps(metadata, sort_keys=True)}
        return node_id

    def external(self, kind: str, name: str) -> str:
        return self.node(f"external::{kind}::{name}", "external_symbol", name.rsplit(".", 1)[-1], name, placed=False, external_kind=kind)

    def file(self, kind: str = "file") -> str:
        return self.node(f"file::{self.path}", kind, self.path.rsplit("/", 1)[-1], self.path, 1, self.n_lines)

    def edge(self, source: str, relation: str, target: str, start: int, end: int | None = None, confidence: float = 1.0, **metadata) -> None:
        row = {"source_id": source, "relation": relation, "target_id": target, "evidence_path": self.path, "start_line": max(1, start), "end_line": max(start, end or start), "extractor": self.extractor, "confidence": confidence, "metadata": json.dumps(metadata, sort_keys=True)}
        self.edges[(source, relation, target, self.path, row["start_line"], self.extractor)] = row


def mask(text: str, strings: bool = True) -> str:
    """The text with comments, and the insides of strings, blanked: offsets and lines stay, braces and names in them don't count."""
    pattern = r"//[^\n]*|/\*.*?(?:\*/|\Z)" + (r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'" if strings else "")

    def blank(m: re.Match) -> str:
        x = m[0]
        if x[0] in "\"'":
            return x[0] + re.sub(r"[^\n]", " ", x[1:-1]) + x[-1]
        return re.sub(r"[^\n]", " ", x)

    return re.sub(pattern, blank, text, flags=re.S)


def closing(masked: str, opening: int) -> int:
    """The place of the brace that closes the one at `opening`, or -1. Comments and strings must be blank."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, opening):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return -1


PARAMETER = re.compile(r"\$?\{[^}/]+\}|:[A-Za-z_]\w*|<[^>/]+>|\[[A-Za-z_]\w*\]")


def canonical_route(raw: str) -> str:
    """As functions.routes.canonical_route, for text at hand."""
    x = raw.strip().strip("\"'")
    x = re.sub(r"^[^:/?#]*://[^/?#]*", "", x) if "://" in x else x
    x = PARAMETER.sub("{}", x.partition("?")[0].partition("#")[0])
    return "/" + "/".join(p for p in x.split("/") if p)


def contract(method: str, *parts: str) -> str:
    return f"{method.upper()} {canonical_route('/'.join(p for p in parts if p))}"
