"""Imports and definitions of other languages, read from the tokens of their declarations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from evigraph.extract.model import Facts
from evigraph.extract.tokens import Token, chain, closing, tokens

SPACE = 40
#: What a reader yields: what is declared (import, namespace or a node's kind), its name, and where.
Found = tuple[str, str, int]
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


class Source:
    """The tokens of a file, with tests that never run past its end."""

    def __init__(self, text: str, suffix: str):
        self.text, self.all = text, tokens(text, suffix)

    def at(self, k: int) -> Token:
        return self.all[k] if 0 <= k < len(self.all) else Token("end", "", len(self.text), len(self.text), False, 0)

    def name(self, k: int, *names: str) -> bool:
        t = self.at(k)
        return t.kind == "name" and (not names or t.text in names)

    def sign(self, k: int, *signs: str) -> bool:
        t = self.at(k)
        return t.kind == "sign" and t.text in signs

    def starts(self) -> Iterator[int]:
        return (k for k, t in enumerate(self.all) if t.first)

    def past(self, k: int, names: frozenset[str]) -> int:
        """The place after such names; those with something in parentheses, as in pub(crate), count whole."""
        while self.name(k, *names):
            k = closing(self.all, k + 1) + 1 if self.sign(k + 1, "(") and self.at(k).text == "pub" else k + 1
        return k

    def generic(self, k: int) -> int:
        """The place after type parameters that begin there, if any do."""
        if not self.sign(k, "<"):
            return k
        depth = 0
        while self.at(k).kind != "end":
            depth += self.sign(k, "<") - self.sign(k, ">")
            k += 1
            if depth == 0:
                break
        return k

    def dotted(self, k: int, *signs: str) -> str:
        """The source from there to the end of the names that these signs join."""
        _, after = chain(self.all, k, signs or (".",))
        return re.sub(r"\s+", "", self.text[self.at(k).at : self.at(after - 1).end])

    def until(self, k: int, stop: str) -> str:
        """The source from there up to that sign."""
        end = next((t.at for t in self.all[k:] if t.kind == "sign" and t.text == stop), len(self.text))
        return " ".join(self.text[self.at(k).at : end].split())


@dataclass(frozen=True)
class Declarations:
    """modifiers: names that may come before a keyword; kinds: what a keyword declares; own: what only this language has, at each start of a line and after its modifiers; anywhere: likewise at each token."""

    modifiers: frozenset[str]
    kinds: dict[str, str]
    own: Callable[[Source, int, int], Iterator[Found]]
    anywhere: Callable[[Source, int], Iterator[Found]] | None = None

    def read(self, s: Source) -> Iterator[Found]:
        for start in s.starts():
            k = s.past(start, self.modifiers)
            kind = self.kinds.get(s.at(k).text) if s.name(k) else None
            if kind and s.name(at := s.generic(k + 1)):
                yield kind, s.at(at).text, s.at(at).at
            yield from self.own(s, start, k)
        if self.anywhere:
            for k in range(len(s.all)):
                yield from self.anywhere(s, k)


def quoted(s: Source, k: int) -> Iterator[Found]:
    if s.at(k).kind == "string":
        yield "import", s.at(k).text, s.at(k).at


def body_follows(s: Source, k: int, *between: str) -> bool:
    """Do parentheses begin there, and after them, and such names, a brace?"""
    return s.sign(k, "(") and s.sign(s.past(closing(s.all, k) + 1, frozenset(between)), "{")


def python(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "from", "import") and s.name(start + 1):
        yield "import", s.dotted(start + 1), s.at(start + 1).at


def script(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "import"):
        at = next((j for j in range(start + 1, len(s.all)) if s.at(j).kind == "string" or s.sign(j, ";", "(", "=")), -1)
        yield from quoted(s, at)
    if s.name(k, "function") and s.sign(k + 1, "*") and s.name(k + 2):
        yield "method", s.at(k + 2).text, s.at(k + 2).at
    if s.name(k, "const") and s.name(k + 1) and s.sign(k + 2, "="):
        value = s.past(k + 3, frozenset({"async"}))
        after = closing(s.all, value) + 1 if s.sign(value, "(") else value + 1
        if s.sign(after, "=>") and (s.sign(value, "(") or s.name(value)):
            yield "method", s.at(k + 1).text, s.at(k + 1).at


def required(s: Source, k: int) -> Iterator[Found]:
    if s.name(k, "require") and s.sign(k + 1, "("):
        yield from quoted(s, k + 2)


def kotlin(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "import", "package") and s.name(start + 1):
        yield "import" if s.name(start, "import") else "namespace", s.dotted(start + 1), s.at(start + 1).at


def c_sharp(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "using") and s.name(at := s.past(start + 1, frozenset({"static"}))) and s.sign(chain(s.all, at, (".",))[1], ";"):
        yield "import", s.dotted(at), s.at(at).at
    if s.name(start, "namespace") and s.name(start + 1):
        yield "namespace", s.dotted(start + 1), s.at(start + 1).at


def c_sharp_method(s: Source, k: int) -> Iterator[Found]:
    """A name before a parenthesis, with a type before it and a modifier before that."""
    if s.name(k) and s.sign(k + 1, "(") and k and (s.name(k - 1) or s.sign(k - 1, ">", "]", "?")):
        back = k - 1
        while back >= 0 and (s.sign(back, ".", "<", ">", "[", "]", "?", ",") or (s.name(back) and not s.name(back, *CS.modifiers, "new", "return", "await", "throw", "else"))):
            back -= 1
        if back < k - 1 and s.name(back, *CS.modifiers):
            yield "method", s.at(k).text, s.at(k).at


def go(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "package") and s.name(start + 1):
        yield "namespace", s.at(start + 1).text, s.at(start + 1).at
    if s.name(start, "import"):
        end = closing(s.all, start + 1) if s.sign(start + 1, "(") else start + 3
        for j in range(start + 1, end):
            yield from quoted(s, j)
    if s.name(start, "type") and s.name(start + 1) and s.name(start + 2, "struct", "interface"):
        yield "class", s.at(start + 1).text, s.at(start + 1).at
    if s.name(start, "func"):
        at = closing(s.all, start + 1) + 1 if s.sign(start + 1, "(") else start + 1
        if s.name(at) and s.sign(at + 1, "(", "["):
            yield "method", s.at(at).text, s.at(at).at


def rust(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(k, "use") or (s.name(k, "mod") and s.sign(k + 2, ";")):
        yield "import", s.until(k + 1, ";"), s.at(k + 1).at


def php(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "use", "namespace") and s.name(at := start + 1 + s.sign(start + 1, "\\")) and s.sign(chain(s.all, at, ("\\",))[1], ";", "{"):
        yield "import" if s.name(start, "use") else "namespace", s.dotted(at, "\\"), s.at(at).at


def included(s: Source, k: int) -> Iterator[Found]:
    if s.name(k, "require", "include", "require_once", "include_once"):
        yield from quoted(s, k + 1 + s.sign(k + 1, "("))


def ruby(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "require", "require_relative"):
        yield from quoted(s, start + 1)
    if s.name(start, "def"):
        at = start + 3 if s.name(start + 1, "self") and s.sign(start + 2, ".") else start + 1
        t, mark = s.at(at), s.at(at + 1)
        if t.kind == "name":
            yield "method", t.text + (mark.text if mark.text in ("?", "!", "=") and mark.kind == "sign" and mark.at == t.end else ""), t.at


def c(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.sign(start, "#") and s.name(start + 1, "include"):
        yield from quoted(s, start + 2)
        if s.sign(start + 2, "<"):
            yield "import", s.until(start + 3, ">"), s.at(start + 3).at
    elif s.at(start).column == 0:  # a function: a type, a name, parentheses, a brace
        at = next((j for j in range(start, min(start + 40, len(s.all))) if s.sign(j, "(", ";", "{", "=", "#")), -1)
        if at - start >= 2 and s.sign(at, "(") and s.name(at - 1) and body_follows(s, at, "const", "noexcept", "override"):
            yield "method", s.at(at - 1).text, s.at(at - 1).at


def mobile(s: Source, start: int, k: int) -> Iterator[Found]:
    if s.name(start, "import"):
        if s.at(start + 1).kind == "string":
            yield from quoted(s, start + 1)
        elif s.name(start + 1):
            yield "import", s.dotted(start + 1), s.at(start + 1).at
    at = s.generic(start + 1)  # a function without a keyword: void or a type, a name, parentheses, a brace
    if s.name(start) and (s.name(start, "void") or s.at(start).text[0].isupper()) and s.name(at) and body_follows(s, at + 1, "async"):
        yield "method", s.at(at).text, s.at(at).at


def modifiers(names: str) -> frozenset[str]:
    return frozenset(names.split())


CS = Declarations(modifiers("public private protected internal static abstract final sealed partial async virtual override readonly unsafe extern new required"), {"class": "class", "record": "class", "struct": "class", "enum": "class", "interface": "interface"}, c_sharp, c_sharp_method)
LANGUAGES: dict[tuple[str, ...], Declarations] = {
    (".py",): Declarations(modifiers("async"), {"class": "class", "def": "method"}, python),
    SCRIPTS: Declarations(modifiers("export default abstract declare async"), {"class": "class", "interface": "interface", "function": "method"}, script, required),
    (".kt", ".kts"): Declarations(modifiers("public private internal protected open abstract sealed data final inline suspend override operator"), {"class": "class", "interface": "interface", "fun": "method"}, kotlin),
    (".cs",): CS,
    (".go",): Declarations(modifiers(""), {}, go),
    (".rs",): Declarations(modifiers("pub async const unsafe"), {"struct": "class", "enum": "class", "trait": "class", "fn": "method"}, rust),
    (".php",): Declarations(modifiers("abstract final public protected private static readonly"), {"class": "class", "interface": "class", "trait": "class", "enum": "class", "function": "method"}, php, included),
    (".rb",): Declarations(modifiers(""), {"class": "class", "module": "class"}, ruby),
    (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp"): Declarations(modifiers("typedef"), {"class": "class", "struct": "class", "enum": "class"}, c),
    (".swift", ".dart"): Declarations(modifiers("public private internal open final abstract static override async fileprivate"), {"class": "class", "struct": "class", "protocol": "class", "enum": "class", "mixin": "class", "func": "method"}, mobile),
}


def analyze(path: str, text: str) -> Facts:
    """A file node for any file; imports and definitions for those of a known language. A name that is defined again keeps its first line."""
    f = Facts(path, text, "generic-structure")
    root = f.file()
    suffix = re.search(r"(\.[^./]+)?$", path)[0].lower()
    language = next((v for k, v in LANGUAGES.items() if suffix in k), None)
    if not language:
        return f
    found = sorted(language.read(Source(text, suffix)), key=lambda x: x[2])
    space = next((name for kind, name, _ in found if kind == "namespace"), None)
    prefix, seen = f"{space}." if space else f"{path}::", set()
    for kind, name, offset in found:
        at = f.line(offset)
        if kind == "import":
            name = name.strip().replace("::", ".")
            if name and name not in seen:
                seen.add(name)
                f.edge(root, "IMPORTS", f.external("module", name), at, confidence=0.9)
        elif kind != "namespace" and (node := f"generic::{path}::{kind}::{name}") not in f.nodes:
            f.node(node, kind, name, prefix + name, at, at, body_end=min(f.n_lines, at + SPACE))
            f.edge(root, "DEFINES", node, at, confidence=0.8)
    return f
