"""Language identification by unigrams whose segmentation is marginalised out.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all ways to
segment it into pieces, by the forward algorithm; expectation maximisation over the words of labelled texts learns
the pieces' probabilities. The language with the largest posterior wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import record_batch, row_hash, slices, strings, table

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
WORD = re.compile(r"[^\W\d_]+")
#: A language's model is learned from about so many of its texts, those whose ids have small hashes.
TEXTS = 1500
ROUNDS = 2
#: The probability of a character that isn't in the vocabulary, the same in every language.
UNKNOWN = 1e-7
#: Added to each piece's expected count; longer words than LONG are scored one by one, with scaling.
SMOOTH, LONG = 0.1, 40
NONE = "und"


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces that consist of lower-case letters, with or without the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    named = (model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return sorted({p for p in named if p == p.lower() and (p == START or WORD.fullmatch(p.removeprefix(START)))})


class Lattice:
    """Finds the pieces that stand in a word."""

    def __init__(self, vocabulary: list[str]):
        self.known: dict[str, int] = {p[:n]: -1 for p in vocabulary for n in range(1, len(p))}
        self.known |= {p: k for k, p in enumerate(vocabulary)}
        self.unknown = len(vocabulary)

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece), by start; a character that is no piece becomes the unknown one."""
        s, known, out = START + word, self.known.get, []
        for i in range(len(s)):
            single = False
            for j in range(i + 1, len(s) + 1):
                k = known(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    out.append((i, j, k))
                    single |= j == i + 1
            if not single:
                out.append((i, i + 1, self.unknown))
        return out

    def packed(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """word, start, end and piece of all edges, by end."""
        flat = [((w * 64 + i) * 64 + j) << 20 | k for w, x in enumerate(words) for i, j, k in self.edges(x)]
        code = np.array(flat, np.int64)
        piece, end, start, word = code & 0xFFFFF, code >> 20 & 63, code >> 26 & 63, code >> 32
        by = np.argsort(end.astype(np.uint8), kind="stable")
        return word[by], start[by], end[by], piece[by]


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1)


def forward(words: list[str], lattice: Lattice, p: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Words of at most LONG letters -> probability of each prefix in each language, and the edges. p: pieces (the unknown one last) x languages."""
    word, start, end, piece = lattice.packed(words)
    n = len(words)
    alpha = np.zeros((LONG + 2, n, p.shape[1]))
    alpha[0] = 1
    cut = np.searchsorted(end, np.arange(LONG + 3))
    for j in range(1, LONG + 2):
        e = slice(cut[j], cut[j + 1])
        if cut[j] < cut[j + 1]:
            alpha[j] = sums(word[e], alpha[start[e], word[e]] * p[piece[e]], n)
    return alpha, (word, start, end, piece, cut)


def logs(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """The natural logarithm of each word's probability in each language."""
    out = np.empty((len(words), p.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    if short:
        alpha, _ = forward([words[k] for k in short], lattice, p)
        out[short] = np.log(alpha[[len(words[k]) + 1 for k in short], np.arange(len(short))])
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = scaled(w, lattice, p)
    return out


def scaled(word: str, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """As logs, for a word of any length: each step is divided by its largest value, which is kept as a logarithm."""
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, j, k in lattice.edges(word):
        ends.setdefault(j, []).append((i, k))
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.ones(p.shape[1]), np.zeros(p.shape[1]))}
    widest = max(j - i for j, v in ends.items() for i, _ in v)
    for j in range(1, len(word) + 2):
        shift = np.max([kept[i][1] for i, _ in ends[j]], axis=0)
        value = sum(kept[i][0] * np.exp(kept[i][1] - shift) * p[k] for i, k in ends[j])
        kept[j] = (np.ones_like(value), shift + np.log(value))
        kept.pop(j - widest, None)
    return kept[len(word) + 1][1]


def expected(words: list[str], weights: np.ndarray, language: np.ndarray, lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece in each language, over words of at most LONG letters."""
    alpha, (word, start, end, piece, cut) = forward(words, lattice, p)
    n = len(words)
    beta = np.zeros_like(alpha)
    beta[np.array([len(w) + 1 for w in words]), np.arange(n)] = 1
    by = np.argsort(start.astype(np.uint8), kind="stable")
    begin = np.searchsorted(start[by], np.arange(LONG + 3))
    for i in range(LONG, -1, -1):
        e = by[begin[i] : begin[i + 1]]
        if len(e):
            beta[i] += sums(word[e], beta[end[e], word[e]] * p[piece[e]], n)
    own = language[word]
    total = beta[0, word, own]
    share = alpha[start, word, own] * p[piece, own] * beta[end, word, own] / total * weights[word]
    return np.bincount(piece * p.shape[1] + own, share, p.size).reshape(p.shape)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    vocabulary: list[str]
    p: np.ndarray
    prior: np.ndarray


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. The pattern also takes numbers such as ½, which are dropped."""
    found = WORD.findall(text.lower())
    return [x for w in found if (x := w if w.isalpha() else "".join(filter(str.isalpha, w)))]


def normal(counts: np.ndarray) -> np.ndarray:
    """Counts of pieces -> probabilities, with a row for the unknown piece."""
    smooth = counts[:-1] + SMOOTH
    return np.vstack([smooth / smooth.sum(0) * (1 - UNKNOWN), np.full(counts.shape[1], UNKNOWN)])


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS, rounds: int = ROUNDS) -> Model | None:
    """Learns from rows with a language and a crc32(id) mod 5 other than 0; None if there is none.

    About `texts` rows of each language count, by hash. The word counts stay distributed; what reaches the driver is a
    number for each piece and language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & (row_hash("id") % 5 != 0))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not shares:
        return None
    languages = list(shares)
    number = F.create_map(*[x for k, v in enumerate(languages) for x in (F.lit(v), F.lit(k))])
    least = F.create_map(*[x for v in languages for x in (F.lit(v), F.lit(min(1.0, texts / shares[v])))])
    drawn = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)) < least[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = record_batch({"lang": (pa.int32(), [k for k, _ in keys]), "word": (pa.string(), [w for _, w in keys]), "n": (pa.int64(), [counts[k] for k in keys])})
            counts.clear()
            return out

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                counts.update((lang, w) for w in words_of(text) if len(w) <= LONG)
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    counted = drawn.select(number[F.col("lang")].cast("int").alias("lang"), "text").mapInArrow(count, "lang int, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    vocabulary = pieces(path)
    p = np.repeat(normal(np.ones((len(vocabulary) + 1, 1))), len(languages), 1)
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(vocabulary), np.zeros(p.shape)
            for batch in slices(batches, 1, most_rows=8192):
                lang, words, n = batch.column(0).to_numpy(), strings(batch.column(1)), batch.column(2).to_numpy()
                total += expected(words, n.astype(float), lang, lattice, p)
            at = np.flatnonzero(total)
            yield record_batch({"at": (pa.int64(), at), "n": (pa.float64(), total.ravel()[at])})

        found = counted.mapInArrow(step, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(p.shape)
        counts.ravel()[found.column("at").to_numpy()] = found.column("n").to_numpy()
        p = normal(counts)
    counted.unpersist()
    prior = np.array([shares[v] for v in languages], float)
    return Model(languages, vocabulary, p, np.log(prior / prior.sum()))


class Scorer:
    """Keeps the logarithms of the words it has seen, up to a bound."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.lattice, self.most = model, Lattice(model.vocabulary), most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, len(self.model.languages)))

    def posterior(self, texts: list[str]) -> np.ndarray:
        """Rows of NaN for texts without a letter."""
        split = [words_of(x) for x in texts]
        if len(self.at) > self.most:
            self.clear()
        new = [w for w in dict.fromkeys(w for x in split for w in x) if w not in self.at]
        self.rows = np.concatenate([self.rows, *(logs(new[k : k + 8192], self.lattice, self.model.p) for k in range(0, len(new), 8192))])
        self.at |= {w: len(self.at) + k for k, w in enumerate(new)}
        out = np.full((len(texts), len(self.model.languages)), np.nan)
        for k, x in enumerate(split):
            if x:
                total = self.model.prior + self.rows[[self.at[w] for w in x]].sum(0)
                e = np.exp(total - total.max())
                out[k] = e / e.sum()
        return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs; no shuffle.

    Whole texts count. Null texts and those without a letter are `und` with score 0, as all are without a model. Equal
    posteriors take the language that sorts first. Repeated rows and ids give a row each, null ids stay null, an empty
    table gives no rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for batch in slices(batches, 1):
            if scorer:
                q = scorer.posterior(strings(batch.column(1)))
                none = np.isnan(q[:, 0])
                best = np.where(none, 0, np.nan_to_num(q).argmax(1))
                named, score = [NONE if x else model.languages[k] for x, k in zip(none, best, strict=True)], np.where(none, 0.0, q[np.arange(len(q)), best])
            else:
                named, score = [NONE] * batch.num_rows, np.zeros(batch.num_rows)
            yield record_batch({"doc_id": (pa.int64(), batch.column(0)), "held_out": (pa.bool_(), batch.column(2)), "lang_pred": (pa.string(), named), "score": (pa.float64(), score)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), row_hash(id_col) % 5 == 0).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, public_path()))
