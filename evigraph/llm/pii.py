"""Personal data: patterns propose spans, checksums and other tests confirm them, context words adjust their score.

The base kinds (email, ip, card, phone) follow fixed rules and always stay. The method adds kinds, which must reach a score:
iban (mod-97), local (a telephone number without a country code), ssn (a number whose parts are issued) and secret (a value set
to a name such as password, a key of a known form, or a run of letters and digits as mixed as a random one).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import record_batch, slices, strings, table

KINDS = ("email", "ip", "card", "phone", "iban", "local", "ssn", "secret")
BASE = 4
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# The lookbehinds only keep a run of digits from being tried again at each of its digits, which would fail in the same way.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
LOCAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)[\x20-]?|[0-9]{2,5}[\x20./-])[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![\w.-]*[0-9])")
DIGIT = re.compile(r"[0-9]")
SSN = re.compile(r"(?<![\w.-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w.-]*[0-9])")
#: Proposals for secrets: a value in quotes after a name and a sign, forms that issuers publish, and long runs.
SET = re.compile(r"(?i:passw|passp|pwd|secret|token|key|credential)[a-z]{0,6}[\"']?\s*(?::=|=>|[:=])\s*([\"'])([^\s\"']{6,200})\1")
FORM = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
MIXED, LONGEST_RUN = 3.0, 512
#: No published form and no long run is shorter, and none holds white space.
SHORTEST = 15
HINT = re.compile(r"[0-9]|AKIA|xox|gh[pousr]_|eyJ")
LONG = re.compile(rf"(?<!\S)\S{{{SHORTEST},}}+")

#: Words that, near a span, raise its score. Fixed values.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "credential", "credentials", "bearer", "authorization", "auth", "passwort", "schlüssel", "clé", "clave", "contraseña"),
}
#: Words that lower it. Fixed values.
AGAINST = {"ip": ("version", "release", "build"), "card": ("order", "serial", "isbn", "id"), "local": ("order", "serial", "isbn", "version", "id", "date"), "ssn": ("order", "serial", "part"), "secret": ("sha", "commit", "checksum", "digest", "hash", "isbn", "uuid")}
#: The score of a span of the kind that its checksum, if there is one, confirms. Fixed values.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.9, "local": 0.3, "ssn": 0.4, "secret": 0.3}
RAISE, LOWER, LEAST, NEAR = 0.35, 0.3, 0.6, 40
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start the longest run up to the end of a word whose checksum holds: words in upper case may follow a number."""
    done = 0
    for m in IBAN_START.finditer(text):
        if m.start() >= done and (most := IBAN.match(text, m.start())):
            ends = [e.start() for e in IBAN_END.finditer(text, m.end(), min(len(text), most.end() + 1)) if e.start() <= most.end()]
            done = next((e for e in reversed(ends) if mod97(text[m.start() : e])), done)
            if done > m.start():
                yield m.start(), done


def mixed(run: str) -> bool:
    """Letters and digits, spread as in a random value: at least MIXED bits a character. Words joined by signs have few digits, numbers no letters."""
    if len(run) > LONGEST_RUN or not DIGIT.search(run) or not any(c.isalpha() for c in run):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= MIXED


def secrets(text: str) -> Iterator[tuple[int, int, bool]]:
    """Starts and ends, and whether the form alone tells, of values set to a name, published forms and mixed runs."""
    if ("=" in text or ":" in text) and ('"' in text or "'" in text):
        for m in SET.finditer(text):
            yield *m.span(2), True
    if any(len(w) >= SHORTEST and HINT.search(w) for w in text.split()):
        yield from runs(text)


def runs(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in LONG.finditer(text):
        for x in FORM.finditer(text, *m.span()):
            yield *x.span(), True
        for x in RUN.finditer(text, *m.span()):
            if mixed(x[0].rstrip("=")):
                yield *x.span(), False


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ finds them, from each @ outwards, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", *x) for x in emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                yield "ip", *m.span()
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                yield "card", *m.span()
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    yield "phone", *m.span()


def score(text: str, kind: str, start: int, end: int, sure: bool = False) -> float:
    near = {w.casefold() for w in WORDS.findall(text, max(0, start - NEAR), start)} | {w.casefold() for w in WORDS.findall(text, end, min(len(text), end + NEAR))}
    value = (0.9 if sure else PRIOR[kind]) + RAISE * any(w in near for w in CONTEXT[kind]) - LOWER * any(w in near for w in AGAINST.get(kind, ()))
    return round(min(1.0, max(0.0, value)), 2)


class Taken:
    """Stretches that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int, around: bool) -> bool:
        """Takes the stretch if it is free, or, where `around`, if it holds whole stretches only."""
        i, j = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        if i < j and not (around and start <= self.starts[i] and self.ends[j - 1] <= end and (start, end) != (self.starts[i], self.ends[j - 1])):
            return False
        self.starts[i:j], self.ends[i:j] = [start], [end]
        return True


def find(text: str) -> list[Span]:
    """All spans by start, then kind in the order of KINDS. A span that is added may hold base spans (digits of a secret may look like a card), but never cuts one."""
    base = list(base_spans(text))
    out = [Span(*x, score(text, *x)) for x in base]
    more: list[tuple[str, int, int, bool]] = []
    if DIGIT.search(text):
        more += [("iban", *x, False) for x in ibans(text)]
        more += [("ssn", *m.span(), False) for m in SSN.finditer(text) if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000"]
    more += [("secret", *x) for x in secrets(text)]
    if DIGIT.search(text):
        more += [("local", *m.span(), False) for m in LOCAL.finditer(text) if 7 <= len(DIGIT.findall(m[0])) <= 12]
    taken = Taken([(s, e) for _, s, e in base])
    for kind, start, end, sure in more:
        if (value := score(text, kind, start, end, sure)) >= LEAST and taken.add(start, end, kind == "secret"):
            out.append(Span(kind, start, end, value))
    return sorted(out, key=lambda x: (x.start, KINDS.index(x.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """Each span becomes <KIND>; of spans that overlap, those that begin earlier, then end later, take the rest's place."""
    parts, at = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= at:
            parts += [text[at : x.start], f"<{x.kind.upper()}>"]
        at = max(at, x.end)
    return "".join(parts) + text[at:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans, a digest of them, all spans and their scores, counts of the added kinds and of all spans for each row of docs; no shuffle.

    Null and empty texts have no span. Repeated rows and ids give a row each, null ids stay null, an empty table gives
    no rows, other columns are ignored. Spans with one start go by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [find(x) for x in strings(batch.column(1))]
            base = [[x for x in f if x.kind in KINDS[:BASE]] for f in found]
            counts = {f"n_{k}": (pa.int64(), [sum(x.kind == k for x in b) for b in base]) for k in KINDS[:BASE]}
            extra = {f"n_{k}": (pa.int64(), [sum(x.kind == k for x in f) for f in found]) for k in KINDS[BASE:]} | {"n_spans": (pa.int64(), [len(f) for f in found])}
            yield record_batch(
                {"doc_id": (pa.int64(), batch.column(0))} | counts
                | {"base_sha256": (pa.string(), [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]), "spans": (pa.string(), [listed(f) for f in found]), "scores": (pa.string(), [",".join(str(x.score) for x in f) for f in found])} | extra
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string, " + ", ".join(f"n_{k} long" for k in (*KINDS[BASE:], "spans"))
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of its texts replaced by their kinds; null texts stay null, other columns stay as they are. No rows: no rows."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = pa.array([x if x is None else redact(x, find(x)) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
