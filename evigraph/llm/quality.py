"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features with a small rate, add up to one lookup table for each feature; then
trees over the pairs that explain most of what is left add up to tables of two features. A score is the sum of the
looked-up values through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import binary, record_batch, row_hash, slices, table

#: The most labelled rows that a model is fitted on: those whose ids have small hashes.
SAMPLE = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "stops", "exclamations", "bars", "distinct_words", "repeated_lines",
    "short_words", "line_words", "longest_word", "beyond_ascii", "entropy", "capital_starts", "symbol_words", "no_stop_lines",
)
SYMBOLS = np.isin(np.arange(256), list(b"#$%&*<>^~=\\_{}[]"))
UPPER, LOWER = np.isin(np.arange(256), range(65, 91)), np.isin(np.arange(256), range(97, 123))
DIGITS, STOPS = np.isin(np.arange(256), range(48, 58)), np.isin(np.arange(256), list(b".,;:?"))
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
SPACE = bytes([32, *range(9, 14)])
ENDS = tuple(bytes([x]) for x in b"#$%&*|<>!")


def features(text: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    inner = int(len(text) - counts[SPACES].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    upper, lower = int(counts[UPPER].sum()), int(counts[LOWER].sum())
    shares = counts[counts > 0] / len(text)
    sizes = list(map(len, words))
    return [
        np.log1p(n), inner / n, counts[SYMBOLS].sum() / inner, upper / max(1, upper + lower), counts[DIGITS].sum() / inner, counts[STOPS].sum() / inner, counts[33] / n, counts[124] / n,
        len(set(words)) / n, 1 - len(set(lines)) / len(lines), sum(x <= 3 for x in sizes) / n, n / len(lines), max(sizes), counts[128:].sum() / inner, float(-(shares * np.log2(shares)).sum()),
        sum(x[0] in range(65, 91) for x in words) / n, sum(x.endswith(ENDS) for x in words) / n, sum(not x.rstrip(SPACE).endswith((b".", b"!", b"?")) for x in lines) / len(lines),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(x) for x in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Model:
    """edges: of each feature's bins; tables: of each feature; pairs: (feature, feature, table over coarse bins of both)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        for a, b, values in self.pairs:
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 edges between distinct values, at quantiles."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def split(gradient: np.ndarray, hessian: np.ndarray, least: float, ridge: float) -> tuple[float, int]:
    """The best cut of a row of bins in two: gain, and first bin of the right part; (0, 0) if there is none."""
    g, h = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
    if not len(g):
        return 0.0, 0
    whole_g, whole_h = gradient.sum(), hessian.sum()
    gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
    gain = np.where((h >= least) & (whole_h - h >= least), gain, 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1 if gain[k] > 0 else 0


def tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """A value for each bin, from a tree of so many leaves, grown best first."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        gain, at, (a, b) = max((*split(gradient[a:b], hessian[a:b], least, ridge), (a, b)) for a, b in parts)
        if not at:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes: gain, and a value for each cell."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    part = lambda m: (m[:-1, :-1], m[:-1, -1:] - m[:-1, :-1], m[-1:, :-1] - m[:-1, :-1], m[-1, -1] - m[:-1, -1:] - m[-1:, :-1] + m[:-1, :-1])
    gs, hs = part(G), part(H)
    gain = sum(x**2 / (y + ridge) for x, y in zip(gs, hs, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [float(x[i, j] / (y[i, j] + ridge)) for x, y in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.1, bins: int = 64, coarse: int = 8, n_pairs: int = 8, leaves: int = 3, least: float = 5.0, ridge: float = 1.0) -> Model:
    """Without labels: score 0.5. With labels of one class: that class's smoothed share."""
    model = Model(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [cuts(x[:, k], bins) for k in range(x.shape[1])]
    model.coarse = [cuts(x[:, k], coarse) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    wide = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(rounds):
        for k, size in enumerate(map(len, model.tables)):
            g, h = slope()
            step = rate * tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), leaves, least, ridge)
            model.tables[k] += step
            total += step[at[k]]
    shape = [len(e) + 1 for e in model.coarse]
    grid = lambda v, a, b: np.bincount(wide[a] * shape[b] + wide[b], v, shape[a] * shape[b]).reshape(shape[a], shape[b])
    g, h = slope()
    ranked = sorted(((quadrants(grid(g, a, b), grid(h, a, b), ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), key=lambda r: (-r[0], r[1:]))
    model.pairs = [(a, b, np.zeros((shape[a], shape[b]))) for gain, a, b in ranked[:n_pairs] if gain > 0]
    for _ in range(rounds // 2):
        for a, b, values in model.pairs:
            g, h = slope()
            step = rate * quadrants(grid(g, a, b), grid(h, a, b), ridge)[1]
            values += step
            total += step[wide[a], wide[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on at most, and about, `sample` labelled rows whose crc32(id) mod 4 is not 2; only their features reach the driver.

    Null labels and ids don't count; of labels that disagree about an id the smallest holds; of rows with one id one counts."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (row_hash(id_col) % 4 != 2)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("double").alias("y"))
    share = int((1 << 30) * min(1.0, sample / max(1, chosen.count())))
    chosen = chosen.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = matrix(binary(batch.column(1)))
            yield record_batch({"doc_id": (pa.int64(), batch.column(0)), "y": (pa.float64(), batch.column(2)), "x": (pa.list_(pa.float64()), x.tolist())})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("doc_id").limit(sample).select("r.x", "r.y").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    return fit(x, (np.array(rows.column("y").to_pylist(), float) > 0).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; no shuffle.

    Null and empty texts have zeros for features and are scored with them. Repeated rows and ids give a row each, null
    ids stay null, an empty table gives no rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            s = model.score(matrix(binary(batch.column(1))))
            yield record_batch({"doc_id": (pa.int64(), batch.column(0)), "held_out": (pa.bool_(), batch.column(2)), "score": (pa.float64(), s), "predicted": (pa.int32(), (s >= threshold).astype(np.int32))})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), (row_hash(id_col) % 4 == 2)).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            keep = model.score(matrix(binary(batch.column(at)))) >= threshold
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
