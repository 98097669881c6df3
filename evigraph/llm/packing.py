"""Vector bin packing of tokenised examples into sequences, by the dot-product heuristic.

An example demands (tokens, segments, loss-bearing tokens); a sequence offers a capacity in each. The open sequence
takes, of the pool's examples that fit, the one whose demand has the largest dot product with what is left, both as
shares of the capacity. If none fits, the one with the largest product is cut so that it fills the sequence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import record_batch, slices, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Example:
    """ids: little-endian unsigned 32-bit, of which start to end are still to be placed; loss: a byte for each id, 1 if it bears loss, or None if all do."""

    row: tuple
    ids: bytes
    start: int
    end: int
    loss: bytes | None = None

    def bearing(self, n: int) -> int:
        """Loss-bearing ids among the next n."""
        return n if self.loss is None else self.loss.count(1, self.start, self.start + n)

    def longest(self, tokens: int, loss: int) -> int:
        """The most of the next ids that fit in so many tokens and so many that bear loss."""
        n = min(tokens, self.end - self.start)
        if self.loss is None:
            return min(n, loss)
        marks = np.frombuffer(self.loss, np.uint8)[self.start : self.start + n]
        return int(np.searchsorted(np.cumsum(marks), loss, side="right"))

    def demand(self) -> tuple[int, int, int]:
        return self.end - self.start, 1, self.bearing(self.end - self.start)


class Packer:
    """Streams examples into sequences; the pool holds at most `most` parts, none of which overfills an empty sequence.

    out gets (*row, start, length, crc32 of the ids, ids of the whole example, sequence, offset) for each piece."""

    def __init__(self, capacity: Capacity, first_id: int = 0, most: int = 512):
        self.full = np.array([capacity.tokens, capacity.segments, capacity.loss], float)
        self.cap, self.next_id, self.most = capacity, first_id, most
        self.pool: list[Example] = []
        self.demand = np.zeros((most, 3))
        self.room, self.used, self.out = self.full.copy(), 0, []

    def _place(self, x: Example, n: int) -> None:
        self.out.append((*x.row, x.start, n, zlib.crc32(x.ids[4 * x.start : 4 * (x.start + n)]), len(x.ids) // 4, self.next_id, self.used))
        self.room -= (n, 1, x.bearing(n))
        self.used += n
        x.start += n

    def _close(self) -> None:
        self.next_id += self.used > 0
        self.room, self.used = self.full.copy(), 0

    def add(self, x: Example) -> None:
        while x.start < x.end:
            n = x.longest(self.cap.tokens, self.cap.loss)
            if n == self.cap.tokens:
                self._place(x, n)
                self._close()
                continue
            if len(self.pool) == self.most:
                self._fill()
            part = Example(x.row, x.ids, x.start, x.start + n, x.loss)
            self.demand[len(self.pool)] = part.demand()
            self.pool.append(part)
            x.start += n

    def _fill(self) -> None:
        """Fills the open sequence from the pool and closes it."""
        while self.pool and (self.room > 0).all():
            demand = self.demand[: len(self.pool)]
            gain = (demand / self.full) @ (self.room / self.full)
            fits = (demand <= self.room).all(1)
            k = int((np.where(fits, gain, -1) if fits.any() else gain).argmax())
            x = self.pool[k]
            self._place(x, x.end - x.start if fits[k] else x.longest(int(self.room[0]), int(self.room[2])))
            if x.start < x.end:
                self.demand[k] = x.demand()
            else:  # the last part takes its place
                self.pool[k], self.demand[k] = self.pool[-1], self.demand[len(self.pool) - 1]
                self.pool.pop()
        self._close()

    def finish(self) -> None:
        """Places the rest of the pool; what doesn't fill a sequence is cut at powers of two, which need no padding."""
        while self.pool:
            rest = sum(x.end - x.start for x in self.pool)
            self.room[0] = min(self.cap.tokens, 1 << (rest.bit_length() - 1)) if rest < self.cap.tokens else self.cap.tokens
            self._fill()


#: The letters for which splitting below and the tokenizer's own agree; words with any other character are encoded as they are.
LETTERS = "a-zß-öø-ÿœšž"
PLAIN = re.compile(rf"[{LETTERS}\x00-\x08\x0E-\x1F!-@\[-`{{-\x7F¡¿«»]+")
PARTS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\n]+")


class Ids:
    """Ids of many words: those of word k stand from start[k] on."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[self.n : self.n + len(lengths)] = lengths
        self.start[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.n += len(lengths)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, one after the other, and how many each has."""
        lengths = self.length[words]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.start[words] - ends + lengths, lengths) + np.arange(int(lengths.sum()))], lengths


class Encoder:
    """Encodes texts as the tokenizer does, but each word once.

    The tokenizer drops white space, never joins what it separates, and splits the rest into runs of letters, digits and runs of
    others; ids depend on the run alone. So the ids of words and of runs are kept, up to a bound. New runs of letters
    are encoded in one text; the last id of each marks a word's end, which tells them apart."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.model, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # words are put in lower case first, which must not make an added token of them
        special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        #: Texts that hold the string of an added token are encoded whole, as the tokenizer cuts them there before all else.
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.most = most
        self.words, self.word_ids = {}, Ids()
        self.runs, self.run_ids = {}, Ids()

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([k for x in ids for k in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _learn_runs(self, runs: list[str]) -> None:
        letters = [x for x in runs if x[0].isalpha()]  # the others begin with a digit, a sign or an apostrophe
        others = [x for x in runs if not x[0].isalpha()]
        for k in range(0, len(letters), 20_000):
            part = letters[k : k + 20_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                self.runs.update(zip(part, range(self.run_ids.n, self.run_ids.n + len(part)), strict=True))
                self.run_ids.add(ids, np.diff(cut, prepend=0))
            else:
                others += part
        self.runs.update(zip(others, range(self.run_ids.n, self.run_ids.n + len(others)), strict=True))
        self.run_ids.add(*self._one_by_one(others))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isascii()]
        lower, rest = plain.copy(), []
        for w in words:
            if not w.isascii():
                x = w.lower()
                if PLAIN.fullmatch(x):
                    plain.append(w)
                    lower.append(x)
                else:
                    rest.append(w)
        parts = PARTS.findall("\n".join(lower))
        self._learn_runs([x for x in dict.fromkeys(parts) if x not in self.runs and x != "\n"])
        get = self.runs.get
        at = np.array([get(x, -1) for x in parts], np.int64)
        ids, lengths = self.run_ids.of(at[at >= 0])
        word = np.cumsum(at < 0)[at >= 0]
        self.words.update(zip([*plain, *rest], range(self.word_ids.n, self.word_ids.n + len(words)), strict=True))
        self.word_ids.add(ids, np.bincount(word, lengths, len(plain)).astype(np.int64))
        self.word_ids.add(*self._one_by_one(rest))

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        texts = pc.fill_null(texts, "")
        if self.special is None:
            return self._by_words(texts)
        marked = pc.match_substring_regex(texts, self.special.pattern)
        if not pc.any(marked).as_py():
            return self._by_words(texts)
        plain = iter(self._by_words(texts.filter(pc.invert(marked))))
        return [np.array(self.whole.encode(x.as_py(), add_special_tokens=False).ids, "<u4").tobytes() if whole else next(plain) for x, whole in zip(texts, marked.to_pylist(), strict=True)]

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        if len(self.words) > self.most:
            self.words, self.word_ids = {}, Ids()
        if len(self.runs) > self.most:
            self.runs, self.run_ids = {}, Ids()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        found = split.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        get = self.words.get
        slots = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            self._learn(new)
            slots[missing] = [get(w) for w in new]
        ids, lengths = self.word_ids.of(slots[found.indices.to_numpy()])
        edge = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy() - split.offsets[0].as_py()] * 4
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: Capacity | None = None, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    An example is the ids of its prompt, if prompt_col is given, and of its text, then END_ID. Prompt ids bear no loss.
    path: the tokenizer's file, the same on all executors. Each partition packs its own rows, in their order, without a
    shuffle; its last sequences are cut at powers of two, so that nothing is padded but for the limits on segments and
    loss. Null and empty texts are END_ID alone. Repeated rows are packed again each, null ids stay null, an empty table
    gives no rows, and other columns are ignored. Equal products take the part that came first."""
    capacity = capacity or Capacity()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END_ID], "<u4").tobytes()
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def rows() -> Iterator[pa.RecordBatch]:
            done, packer.out = packer.out, []
            if done:
                columns = list(zip(*done, strict=True))
                yield record_batch({n: (pa.int64(), columns[i]) for i, n in enumerate(x.split()[0] for x in SCHEMA.split(", "))})

        for batch in slices(batches, 1, most_bytes=8 << 20):
            prompts = encoder.encode(batch.column(2)) if prompt_col else [b""] * batch.num_rows
            for key, text, head in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), prompts, strict=True):
                ids = head + text + end
                loss = bytes(len(head) // 4) + b"\1" * ((len(ids) - len(head)) // 4) if head else None
                packer.add(Example((key,), ids, 0, len(ids) // 4, loss))
            yield from rows()
        packer.finish()
        yield from rows()

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")] + ([F.col(prompt_col).cast("string").alias("prompt")] if prompt_col else [])
    return docs.select(*columns).mapInArrow(run, SCHEMA)


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path())
