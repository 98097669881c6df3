"""Tokens of program texts, and what is read from them alike in all languages: calls, their arguments, annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

HASH, SLASHES, BOTH = "hash", "slashes", "both"
SCRIPT = {".py": HASH, ".rb": HASH, ".php": BOTH}
#: Suffixes whose strings may stand in backquotes; whose single quotes also mark lifetimes or characters; whose strings may hold lines between three quotes.
BACKQUOTES, TICKS, TRIPLE = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go"), (".rs", ".kt", ".kts", ".java", ".cs", ".go", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".swift"), (".py", ".kt", ".kts", ".java", ".swift", ".dart")
OPEN, CLOSE = "([{", ")]}"


@dataclass(frozen=True, slots=True)
class Token:
    """kind: name, string (its text is what stands between the quotes), number or sign. first: it begins its line, at column `column`."""

    kind: str
    text: str
    at: int
    end: int
    first: bool
    column: int


@lru_cache
def lexer(suffix: str) -> re.Pattern:
    comments = SCRIPT.get(suffix, SLASHES)
    parts = [r"(?P<line>\n)", r"(?P<space>[^\S\n]+)"]
    parts += [r"(?P<remark>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))"] if comments != HASH else []
    parts += [r"(?P<hash>\#(?!\[)[^\n]*)"] if comments != SLASHES else []
    parts += [r'(?P<triple>[A-Za-z]{0,2}(?P<three>"""|\'\'\')(?s:.*?)(?:(?P=three)|\Z))'] if suffix in TRIPLE else []
    quotes = ['"(?:\\\\.|[^"\\\\\n])*"', r"'(?:\\.|[^'\\\n])'" if suffix in TICKS else r"'(?:\\.|[^'\\\n])*'"]
    quotes += [r"`(?s:\\.|[^`\\])*`"] if suffix in BACKQUOTES else []
    prefix = "[rbfuRBFU]{0,2}" if suffix in (".py", ".rs") else ""
    parts += [rf"(?P<string>{prefix}(?:{'|'.join(quotes)}))", r"(?P<name>[^\W\d][\w$]*|\$[\w$]+)", r"(?P<number>\d[\w.]*)", r"(?P<sign>=>|::|->|:=|.)"]
    return re.compile("|".join(parts))


def tokens(text: str, suffix: str) -> list[Token]:
    """Without white space and comments. A quote that its line doesn't close is a sign."""
    out: list[Token] = []
    start, first = 0, True
    for m in lexer(suffix).finditer(text):
        kind = m.lastgroup if m.lastgroup != "three" else "triple"
        if kind == "line":
            start, first = m.end(), True
            continue
        if kind in ("space", "remark", "hash"):
            continue
        value = m[0]
        if kind in ("string", "triple"):
            value = value.lstrip("rbfuRBFU") if value[0] not in "\"'`" else value
            value, kind = value[3:-3] if kind == "triple" else value[1:-1], "string"
        out.append(Token(kind, value, m.start(), m.end(), first, m.start() - start))
        first = False
    return out


def closing(found: list[Token], at: int) -> int:
    """The place of the bracket that closes the one at `at`, or the number of tokens."""
    depth = 0
    for k in range(at, len(found)):
        if found[k].kind == "sign":
            depth += (found[k].text in OPEN) - (found[k].text in CLOSE)
            if depth == 0:
                return k
    return len(found)


def chain(found: list[Token], at: int, signs: tuple[str, ...] = (".", "::")) -> tuple[list[str], int]:
    """The names that stand from there on with such signs between them, and the place after them."""
    names: list[str] = []
    while at < len(found) and found[at].kind == "name":
        names.append(found[at].text)
        if at + 2 < len(found) and found[at + 1].text in signs and found[at + 1].kind == "sign" and found[at + 2].kind == "name":
            at += 2
            continue
        return names, at + 1
    return names, at


def arguments(found: list[Token], opening: int) -> list[list[Token]]:
    """The tokens of each argument between that bracket and its end."""
    out, k, end = [[]], opening + 1, closing(found, opening)
    while k < end:
        if found[k].kind == "sign" and found[k].text == ",":
            out.append([])
        elif found[k].kind == "sign" and found[k].text in OPEN:
            stop = closing(found, k)
            out[-1] += found[k : stop + 1]
            k = stop
        else:
            out[-1].append(found[k])
        k += 1
    return [x for x in out if x]


@dataclass(frozen=True)
class Call:
    """names: of the callee, outermost first. mark: @ for a decorator or annotation, [ for an attribute, #[ for Rust's, else empty."""

    names: list[str]
    mark: str
    at: int
    arguments: list[list[Token]]

    def text(self, k: int) -> str | None:
        """The string that the argument is or begins with, whatever signs mark it."""
        own = [x for x in (self.arguments[k] if k < len(self.arguments) else []) if not (x.kind == "sign" and x.text in "$@&")]
        return own[0].text if own and own[0].kind == "string" else None

    def name(self, k: int) -> str | None:
        """The names that the argument begins with, joined by points."""
        own = self.arguments[k] if k < len(self.arguments) else []
        return ".".join(chain(own, 0)[0]) or None


def calls(found: list[Token]) -> Iterator[Call]:
    """Calls, decorators and attributes in order of their names; those in the arguments of others as well."""
    k = 0
    while k < len(found):
        t = found[k]
        if t.kind != "name" or (k and found[k - 1].text in (".", "::") and found[k - 2].kind == "name" and found[k - 1].kind == "sign"):
            k += 1
            continue
        names, after = chain(found, k)
        before = found[k - 1].text if k and found[k - 1].kind == "sign" else ""
        mark = "@" if before == "@" else "#[" if before == "[" and k > 1 and found[k - 2].text == "#" else "[" if before in ("[", ",") else ""
        at = found[k - 1].at if mark == "@" else t.at
        if after < len(found) and found[after].kind == "sign" and found[after].text == "(":
            yield Call(names, mark, at, arguments(found, after))
        elif mark in ("[", "@"):
            yield Call(names, mark, at, [])
        k = after
