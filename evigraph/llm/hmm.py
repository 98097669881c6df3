"""Language-model scoring by a hidden Markov model.

Words are counted over all training texts. The model's symbols are the most frequent words, one for all other words
(whose counts then tell them apart), and a text's end. Baum-Welch counts of each partition are added up to train the latent
states, over all training texts and alike at every size; the scaled forward recursion gives the exact likelihood of each whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, binary, cut, record_batch, row_hash, slices, table

#: Latent states, words with a symbol of their own, and words whose counts go to every task; all bound what is sent.
STATES, SYMBOLS, HEAD = 6, 16_384, 131_072
#: Stepwise Baum-Welch goes once through all training texts, dealt by hash of their id into PARTS parts, and renews the
#: model after each; ROUNDS rounds over all of them follow. The k-th part's counts have weight (k + 2) ** -DECAY.
PARTS, ROUNDS, DECAY = 16, 2, 0.7
#: Symbols that a training task takes, if there are that many for each core: the recursions of long texts then run side by side.
TASK_SYMBOLS = 4_000_000
#: A word has no space, so this key is free for the end.
END = b" "
PRIOR, SEED = 10.0, 7


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z and ASCII white space only


@dataclass(frozen=True)
class Model:
    """start: states; move: states x states; emit: symbols x states. The last two symbols are other words and the end."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Batch:
    """Sequences of symbols laid out by time: those that are as long as t + 1 stand side by side at t, longest first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(x) for x in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.width = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), side="right")
        self.first = np.concatenate([[0], np.cumsum(self.width)])
        self.row = np.concatenate([np.arange(w) for w in self.width]) if len(self.width) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.symbols = np.empty(len(rank), np.int64)
        self.symbols[self.first[at] + rank] = np.concatenate([sequences[k] for k in self.order]) if len(rank) else []

    def forward(self, m: Model, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """log10 likelihoods in the order given; each step's scale; each step's scaled state probabilities, if they are to be kept."""
        scale = np.empty(len(self.symbols))
        kept = np.empty((len(self.symbols), len(m.start))) if keep else None
        a = np.broadcast_to(m.start, (len(self.order), len(m.start)))
        for t, n in enumerate(self.width.tolist()):
            s = slice(self.first[t], self.first[t] + n)
            a = (a[:n] @ m.move if t else a[:n]) * m.emit[self.symbols[s]]
            c = a.sum(1)
            a = a / c[:, None]
            scale[s] = c
            if keep:
                kept[s] = a
        out = np.zeros(len(self.order))
        out[self.order] = np.bincount(self.row, np.log10(scale), len(self.order))
        return out, scale, kept

    def expect(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts for start, move and emit."""
        _, scale, alpha = self.forward(m, keep=True)
        move, beta, after = np.zeros_like(m.move), np.ones((0, len(m.start))), 0
        for t in range(len(self.width) - 1, -1, -1):
            n = int(self.width[t])
            s = slice(self.first[t], self.first[t] + n)
            b = np.ones((n, len(m.start)))
            if after:
                move += alpha[self.first[t] : self.first[t] + after].T @ beta
                b[:after] = beta @ m.move.T
            a = alpha[s]
            beta = m.emit[self.symbols[s]] * b / scale[s][:, None]
            after = n
            alpha[s] = a * b
        emit = np.stack([np.bincount(self.symbols, alpha[:, k], len(m.emit)) for k in range(len(m.start))], axis=1)
        return alpha[: self.width[0]].sum(0) if len(self.width) else np.zeros(len(m.start)), move * m.move, emit


def improved(m: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
    """Expected counts, smoothed towards even moves and the unigram distribution -> the next model."""
    start, move, emit = start + 1, move + 1, emit + PRIOR * unigram[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(unigram: np.ndarray, states: int) -> Model:
    """States that mostly stay, and emit as the unigrams do but for fixed noise that tells them apart."""
    emit = unigram[:, None] * (0.5 + np.random.default_rng(SEED).random((len(unigram), states)))
    move = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def grouped(sequences: Iterable[tuple[object, np.ndarray]], most: int = 500_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Sequences of like length, in groups of about so many symbols: a step then serves many."""
    held: dict[int, tuple[list, list]] = {}
    sizes: Counter = Counter()
    for key, x in sequences:
        kind = 0 if len(x) < 1000 else 1 if len(x) < 4000 else 2
        keys, rows = held.setdefault(kind, ([], []))
        keys.append(key)
        rows.append(x)
        sizes[kind] += len(x)
        if sizes[kind] >= most:
            yield held.pop(kind)
            sizes[kind] = 0
    yield from held.values()


@dataclass(frozen=True)
class Words:
    """What the corpus says of words: N and V of the training tokens, the end's count, and the most frequent words with theirs, in order."""

    total: int
    distinct: int
    ends: int
    head: list[bytes]
    counts: list[int]
    symbols: int = SYMBOLS

    def unigram(self) -> np.ndarray:
        own = np.array([*self.counts[: self.symbols], 0, self.ends], float)
        own[-2] = self.total - own.sum()
        return (own + 1) / (own + 1).sum()

    def numbers(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.head[: self.symbols])}

    def other(self) -> tuple[int, int]:
        """Tokens and distinct words that have no symbol of their own."""
        own = self.counts[: self.symbols]
        return self.total - sum(own) - self.ends, max(0, self.distinct - len(own) - (self.ends > 0))


def count_words(texts: DataFrame) -> DataFrame:
    """texts (text) -> (word, n) over words and ends; each task adds up what it holds before rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: record_batch({"word": (pa.binary(), list(counts)), "n": (pa.int64(), list(counts.values()))})
        for batch in slices(batches, 0):
            for x in binary(batch.column(0)):
                counts.update(tokens(x))
            counts[END] += batch.num_rows
            if len(counts) > 600_000:
                yield flush()
                counts.clear()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequency_class(n: Column) -> Column:
    """An integer that doesn't fall as the count grows, with few values: the count itself, then 512 steps for each doubling."""
    return F.when(n < 4096, n).otherwise(4096 + F.floor(F.log2(n) * 512)).cast("long")


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most so many words of counts (word, n), by count, then bytes: all those from some frequency class on, so no task or message holds more."""
    classes = counts.groupBy(frequency_class(F.col("n")).alias("c")).agg(F.count("*").alias("words")).orderBy(F.desc("c")).collect()
    total, least = 0, None
    for r in classes:
        total += r["words"]
        if total > most:
            break
        least = r["c"]
    if least is None:
        return []
    found = counts.filter(frequency_class(F.col("n")) >= least).select("word", "n").toArrow()
    return sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))


def encoded(texts: DataFrame, words: Words) -> DataFrame:
    """texts (part, text) -> (part, symbols): each text as 16-bit numbers of its words' symbols and the end's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = words.numbers()
        get, other = numbers.get, len(numbers)
        for batch in slices(batches, 1):
            coded = [np.array([*[get(w, other) for w in tokens(x)], other + 1], np.uint16).tobytes() for x in binary(batch.column(1))]
            yield record_batch({"part": (pa.int32(), batch.column(0)), "symbols": (pa.binary(), coded)})

    return texts.mapInArrow(run, "part int, symbols binary")


def train(texts: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS, parts: int = PARTS) -> Model:
    """Baum-Welch over texts (doc_id, text): stepwise through all parts, then rounds over all texts.

    Texts are turned into symbols once, in the shared folder, one folder a part, so that a step reads its own part alone.
    A part without a text changes nothing."""
    unigram = words.unigram()
    if len(unigram) > 1 << 16:
        raise ValueError("symbols have 16 bits")
    model, held = first_model(unigram, states), None
    scratch = Scratch(texts.sparkSession, "hmm")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part")
    encoded(texts.select(part, "text"), words).write.partitionBy("part").parquet(f"{scratch.path}/symbols")
    symbols = texts.sparkSession.read.schema("symbols binary, part int").parquet(f"{scratch.path}/symbols")
    schema = "at int, " + ", ".join(f"n{k} double" for k in range(states))

    def expected(df: DataFrame, m: Model, share: float = 1.0) -> np.ndarray:
        """Counts over all partitions: a row for the start, one for each state and one for each symbol. df holds about that share of the symbols."""
        tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(share * words.total / TASK_SYMBOLS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(s) for s in (states, (states, states), (len(unigram), states))]
            rows = ((None, np.frombuffer(x, np.uint16)) for batch in slices(batches, 0) for x in batch.column(0).to_pylist())
            for _, group in grouped(rows):
                for a, b in zip(total, Batch(group).expect(m), strict=True):
                    a += b
            flat = np.concatenate([total[0][None], total[1], total[2]])
            at = np.flatnonzero(flat.any(1))
            yield record_batch({"at": (pa.int32(), at), **{f"n{k}": (pa.float64(), flat[at, k]) for k in range(states)}})

        found = df.select("symbols").coalesce(tasks).mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(states)]).toArrow()
        out = np.zeros((1 + states + len(unigram), states))
        if found.num_rows:
            out[found.column("at").to_numpy()] = np.stack([found.column(f"n{k}").to_numpy() for k in range(states)], axis=1)
        return out

    def renewed(n: np.ndarray) -> Model:
        return improved(model, n[0], n[1 : 1 + states], n[1 + states :], unigram)

    for k in range(parts):
        new = expected(symbols.filter(F.col("part") == k), model, 1 / parts)
        if new.any():
            weight = (k + 2) ** -DECAY
            held = new if held is None else (1 - weight) * held + weight * new
            model = renewed(held)
    for _ in range(rounds):
        model = renewed(expected(symbols, model))
    scratch.drop("symbols")
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, symbols: int = SYMBOLS, head: int = HEAD, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Learns from the rows whose crc32(id) mod 7 is not 2. Null and empty texts are an end alone. A word beyond the head gets
    its count by a join, so no task holds the vocabulary; words that were never seen share the probability of one.
    Repeated rows and ids give a row each, null ids stay null, an empty table gives no rows, a table without training
    rows has N and V 0, other columns are ignored. Words of equal count are ranked by their bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (row_hash(id_col) % 7 == 2).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = cut(count_words(training.select("text")))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    top = frequent(counts.filter((F.col("word") != END) & (F.col("n") > 0)), head)
    words = Words(sums["n"] or 0, sums["v"] or 0, sums["ends"] or 0, [w for w, _ in top], [n for _, n in top], symbols)
    model = train(training.select("doc_id", "text"), words, states, rounds, parts)
    other_tokens, other_words = words.other()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other, row = len(model.emit) - 2, TaskContext.get().partitionId() << 40
        get = {w: k for k, w in enumerate(words.head)}.get
        logs = np.log10(np.array([*words.counts, 0], float) + 1)  # the last, at -1, is for words beyond the head
        symbol = np.minimum(np.arange(len(words.head) + 1), other)
        symbol[-1] = other
        end = float(np.log10(words.ends + 1))

        def sequences() -> Iterator[tuple[tuple, np.ndarray]]:
            nonlocal row
            for batch in slices(batches, 1):
                for key, x, held in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    text = tokens(x)
                    at = np.array([get(w, -1) for w in text], np.int64)
                    rare = Counter([text[k] for k in np.flatnonzero(at < 0).tolist()])
                    own, log = symbol[at], logs[at]
                    alike = own == other
                    yield (row, key, held, len(text) + 1, int((at >= 0).sum()) + (words.ends > 0), float(log.sum()) + end, float(log[alike].sum()), int(alike.sum()), rare), np.append(own, other + 1)
                    row += 1

        for infos, group in grouped(sequences()):
            likelihood, _, _ = Batch(group).forward(model)
            for k in range(0, len(infos), 2000):
                part, whole = infos[k : k + 2000], likelihood[k : k + 2000]
                c = list(zip(*part, strict=True))
                yield record_batch({
                    "row": (pa.int64(), c[0]), "doc_id": (pa.int64(), c[1]), "held_out": (pa.bool_(), c[2]), "n_tokens": (pa.int64(), c[3]), "n_known": (pa.int64(), c[4]), "base": (pa.float64(), c[5]),
                    "model": (pa.float64(), np.array(c[6]) + whole - np.array(c[7]) * np.log10(other_tokens + other_words + 1)),
                    "words": (pa.list_(pa.binary()), [list(x) for x in c[8]]), "times": (pa.list_(pa.int64()), [list(x.values()) for x in c[8]]),
                })

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, words array<binary>, times array<long>"
    scored = rows.select("doc_id", "text", "held_out").mapInArrow(run, schema)
    # one row for each rare word of a text, and one, under a key that no word equals, that carries the rest
    info = F.struct("doc_id", "held_out", "n_tokens", "n_known", "base", "model")
    own = F.struct(F.encode(F.concat(F.lit(" "), F.col("row").cast("string")), "utf-8").alias("word"), F.lit(0).cast("long").alias("n"))
    items = F.concat(F.zip_with("words", "times", lambda w, n: F.struct(w.alias("word"), n.alias("n"))), F.array(own))
    each = scored.select("row", info.alias("info"), F.explode(items).alias("item")).select("row", F.when(F.col("item.n") == 0, F.col("info")).alias("info"), F.col("item.word").alias("word"), F.col("item.n").alias("times"))
    joined = each.join(counts.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    whole = joined.groupBy("row").agg(F.max("info").alias("info"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10(c + 1)).alias("logs"))
    n, v = words.total, words.distinct
    return whole.select(
        "info.doc_id", "info.held_out", "info.n_tokens", (F.col("info.n_known") + F.col("known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("info.base") + F.col("logs") - F.col("info.n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"), (F.col("info.model") + F.col("logs")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
