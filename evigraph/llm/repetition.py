"""Quality rules on repetition, from a suffix array over the words of each text.

The suffixes of all texts of a batch are sorted together by prefix doubling; a word's rank holds its text, so no
repeat crosses texts. The ranks of each round give the longest common prefix (LCP) of neighbours. A suffix's larger LCP is the
longest repeated run of words that starts there. An occurrence is maximal unless the word before starts a repeat that is
one word longer; the spans of the maximal occurrences, united, are the repeated part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import record_batch, slices, strings, table

SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_SYMBOL = bytes(x for x in range(256) if x not in b"#*$%&|<>")


@dataclass(frozen=True)
class Limits:
    """window: words in a base window. least: words in a repeat that the verdict counts. covered: largest fraction of a
    text's word characters within such repeats. longest: most words in one repeat. A line of a dozen words that stands twice
    in a text of 60 stays within both; a paragraph that stands twice, or lines that fill two fifths of a text, don't."""

    window: int = 3
    least: int = 6
    covered: float = 0.4
    longest: int = 30
    base_words: int = 50
    base_percent: int = 50


def suffix_array(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """words: a number for each word; text: the text it is in, ascending. -> suffixes in order; ranks by the first 1, 2, 4 ... words."""
    n = len(words)
    order = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    rank, levels, step = np.empty(n, np.int64), [], 1
    where = np.arange(n)
    sort = (text * (int(words.max(initial=0)) + 1) + words)[order]
    while True:
        first = np.r_[True, sort[1:] != sort[:-1]]
        rank[order[where]] = where[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.copy())
        size = np.diff(np.r_[np.flatnonzero(first), len(where)])
        where = where[np.repeat(size > 1, size)]
        if not len(where):
            return order, levels
        at = order[where]
        then = at + step
        inside = then < n
        then[~inside] = 0
        second = np.where(inside & (text[then] == text[at]), rank[then] + 1, 0)
        key = rank[at] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        order[where], sort = at[by], key[by]
        step *= 2


def repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, how many words from there on also stand elsewhere in its text."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order, levels = suffix_array(words, text)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    end = np.r_[np.flatnonzero(text[1:] != text[:-1]) + 1, n]
    end = end[np.searchsorted(end, np.arange(n), side="right")]
    for k in range(len(levels) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        x, y = a[live], b[live]
        same = (levels[k][x] == levels[k][y]) & (text[x] == text[y]) & (x != y)
        same &= (x + (1 << k) <= end[x]) & (y + (1 << k) <= end[y])
        go = live[same]
        a[go] += 1 << k
        b[go] += 1 << k
        lcp[go] += 1 << k
    most = np.zeros(n, np.int64)
    most[order[:-1]] = lcp
    most[order[1:]] = np.maximum(most[order[1:]], lcp)
    return most


def maximal(most: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The words at which a maximal occurrence of a repeat starts."""
    return np.flatnonzero((most > 0) & np.r_[True, (most[:-1] != most[1:] + 1) | (text[:-1] != text[1:])]) if len(most) else np.zeros(0, np.int64)


def covered(most: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least so many words."""
    at = np.arange(len(most))
    return np.maximum.accumulate(np.where(most >= least, at + most, 0)) > at if len(most) else np.zeros(0, bool)


def measure(texts: list[str], limits: Limits) -> dict[str, np.ndarray]:
    flat: list[int] = []
    numbers: dict[bytes, int] = {}
    count, chars, symbols, lines, lengths = [], [], [], [], []
    for x in texts:
        raw = x.encode("utf-8", "surrogatepass")
        words = raw.split()
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        lengths += map(len, words)
        count.append(len(words))
        chars.append(len(x) - (len(raw) - len(raw.translate(None, SPACE))))
        symbols.append(len(raw.translate(None, NOT_SYMBOL)))
        worded = [y for y in raw.split(b"\n") if y.strip(SPACE)]
        lines.append(len(worded) - len(set(worded)))
    sizes = np.array(count, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    most = repeats(np.array(flat, np.int64), text)
    length = np.array(lengths, np.int64)
    by_text = lambda v: np.bincount(text, weights=v, minlength=len(texts)).astype(np.int64)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, most)
    start = np.concatenate([[0], np.cumsum(sizes)])
    starts = maximal(most, text)
    starts = starts[most[starts] >= limits.least]
    many = np.bincount(text[starts], minlength=len(texts))
    begins = np.full(len(texts), -1, np.int64)
    tops = starts[most[starts] == longest[text[starts]]][::-1]
    begins[text[tops]] = tops - start[text[tops]]
    repeated, wide = np.zeros(len(most), bool), np.zeros(len(most), bool)
    # a repeat ends within its text, so the running maximum never leaks into the next one
    repeated[:], wide[:] = covered(most, limits.window), covered(most, limits.least)
    assert start[-1] == len(most)
    n_repeat = by_text(repeated)
    share = by_text(wide * length) / np.maximum(1, by_text(length))
    failed = (sizes < limits.base_words) | (100 * n_repeat > limits.base_percent * sizes)
    return {
        "n_words": sizes, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & (share <= limits.covered) & (longest <= limits.longest),
        "repeat_share": share, "longest_repeat": longest, "n_repeats": many, "longest_start": begins,
    }


TYPES = {k: pa.int64() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": pa.bool_(), "kept": pa.bool_(), "repeat_share": pa.float64(), "longest_repeat": pa.int64(), "n_repeats": pa.int64(), "longest_start": pa.int64()}


def repetition_rules(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts and the verdict for each row of docs, whole texts only; no shuffle.

    repeat_share: of word characters, within repeats of at least `least` words; longest_repeat: in words; n_repeats: maximal
    occurrences of such repeats; longest_start: the number of the word at which the first longest one starts, -1 without any.

    Null and empty texts have no word, fail the base rule and aren't kept. Repeated rows and repeated ids give a row
    each, null ids stay null, an empty table gives no rows, and other columns are ignored, whatever their names. A
    repeat may overlap itself; ties need no choice, as every repeat is counted."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, most_bytes=2 << 20):
            found = measure(strings(batch.column(1)), limits)
            yield record_batch({"doc_id": (pa.int64(), batch.column(0))} | {k: (t, found[k]) for k, t in TYPES.items()})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_share double, longest_repeat long, n_repeats long, longest_start long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
