"""WARC archives: writing captures, reading records, and assembling transactions through concurrent-to identifiers.

A record ends with two line breaks, so Spark's text sink with that separator writes valid archives to any store it knows, under
its own commit protocol. They are read as a stream: the text source hands on the bytes between separators, which are put
together again and cut by the records' lengths, so that no task holds more than a record and a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evigraph.llm.common import Scratch, cut, record_batch, table

CRLF = "\r\n"
SEPARATOR = b"\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAIN = ("response", "revisit", "resource")
#: The date of all records, so that reruns write the same archives; the smallest payload that may be revisited; the captures in a file; the salts that split a payload's copies.
DATE = "2024-01-01T00:00:00Z"
LEAST = 1000
FILE_ROWS = 1500
SALTS = 32


def lines(*fields: tuple[str, Column | str]) -> Column:
    """Header lines; those whose value is null are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), F.lit(v) if isinstance(v, str) else v, F.lit(CRLF)), F.lit("")) for k, v in fields])


def record(kind: str, own: Column, fields: list[tuple[str, Column | str]], *block: Column) -> Column:
    """A record whose block is the parts of block one after the other; a long part is copied once."""
    size = sum((F.octet_length(b) for b in block[1:]), F.octet_length(block[0]))
    head = lines(("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), *fields, ("Content-Length", size.cast("string")))
    return F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF), *block)


def urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(value): the text of a request, a response or revisit, and a metadata record for each row of pages.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is the response, by url where ids
    are equal; the others revisit it. Null payloads are empty, null ids are left out of the metadata, null urls have no
    target. Repeated rows are told apart by a number. Copies of a payload are split over salts where they meet."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("payload", "utf-8")), "bytes": F.octet_length("payload")})
    best = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max(F.struct("id", "url")).alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = best.select("digest", "bytes", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # the payloads move once: repeated rows share a salt, so the window finds them together after the join
    rows = rows.withColumn("salt", F.pmod(F.hash("id", "url"), F.lit(SALTS))).join(best, ["digest", "bytes", "salt"], "left")
    rows = rows.withColumn("number", F.row_number().over(W.partitionBy("digest", "bytes", "salt", "id", "url").orderBy("bytes")))
    first = F.col("best").isNull() | (F.col("best.id").eqNullSafe(F.col("id")) & F.col("best.url").eqNullSafe(F.col("url")) & (F.col("number") == 1))
    key = [F.col("id"), F.col("digest"), F.col("url"), F.col("number")]
    main, target = urn("main", *key), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    shared = [("WARC-Target-URI", target), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    kind = ("Content-Type", "application/http;msgtype=response")
    response = record("response", main, [*shared, kind], http, F.col("payload"))
    refers = urn("main", F.col("best.id"), F.col("digest"), F.col("best.url"), F.lit(1))
    revisit = record("revisit", main, [*shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), kind], http)
    host = F.coalesce(F.nullif(F.regexp_extract(target, r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")), F.lit("localhost"))
    path = F.coalesce(F.nullif(F.regexp_extract(target, r"^[^:/?#]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = record("request", urn("request", *key), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)))
    metadata = record("metadata", urn("metadata", *key), [("WARC-Target-URI", target), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")], lines(("page-id", F.col("id").cast("string"))))
    return rows.select(F.explode(F.array(request, F.when(first, response).otherwise(revisit), metadata)).alias("value"))


def write(pages: DataFrame, path: str, level: str = "BEST_SPEED", **columns) -> None:
    """Writes the records of pages as gzip archives below path. The level is one of zlib's: of pages the fastest makes archives about an eighth larger than the default in a fifth of the time."""
    records(pages, **columns).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", level).option("maxRecordsPerFile", 3 * FILE_ROWS).text(path)


def fields(head: bytes) -> list[tuple[str, str]]:
    """Names, in lower case, and values; lines that go on are joined."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split(CRLF):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def parse(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive that comes in chunks, in order. A record that is cut short, or bytes that start none, raise ValueError."""
    chunks, held, at, begins = iter(chunks), bytearray(), 0, 0

    def more() -> bool:
        chunk = next(chunks, None)
        held.extend(chunk or b"")
        return chunk is not None

    while True:
        while held[at : at + 2] == CRLF.encode() or (len(held) - at < 2 and more()):
            at += 2 * (held[at : at + 2] == CRLF.encode())
        del held[:at]
        begins, at, end, tried = begins + at, 0, -1, 0
        if not held:
            return
        while held[:5] == b"WARC/"[: len(held)] and (end := held.find(b"\r\n\r\n", tried)) < 0:
            tried = max(0, len(held) - 3)
            if not more():
                break
        if end < 0:
            raise ValueError(f"no record at byte {begins}")
        head = fields(bytes(held[held.index(b"\r\n") + 2 : end]))
        first = dict(reversed(head))
        at = end + 4 + int(first["content-length"])
        while len(held) < at:
            if not more():
                raise ValueError(f"the record at byte {begins} is cut short")
        block = bytes(held[end + 4 : at])
        kind, body = first.get("content-type", ""), block
        if kind.startswith("application/http"):
            body = block.partition(b"\r\n\r\n")[2]
        yield {
            "record_id": first.get("warc-record-id"), "warc_type": first.get("warc-type"), "target_uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
            "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"], "refers_to": first.get("warc-refers-to"), "digest": first.get("warc-payload-digest"),
            "fields": fields(block) if kind.startswith("application/warc-fields") else [], "payload": body, "payload_bytes": len(body), "payload_sha1": hashlib.sha1(body).hexdigest(),
        }


RECORD = "record_id string, warc_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, digest string, fields map<string,string>, payload binary, payload_bytes long, payload_sha1 string"


#: Records, or bytes of payload, that a task gathers before it hands them on.
BATCH, BATCH_BYTES = 500, 16 << 20


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives (any *.gz, and plain *.warc) below path. Without payloads their column is null, but bytes and digest are theirs.

    An archive that is compressed isn't split, so a task has its parts one after the other. The parts of a plain one may come
    from several tasks; they are brought together and put in order by a sort, which spills. Empty archives give no rows."""

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        text = dict.fromkeys(("record_id", "warc_type", "target_uri", "date", "refers_to", "digest", "payload_sha1"), pa.string())
        types = text | {"concurrent_to": pa.list_(pa.string()), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "payload_bytes": pa.int64()}
        return record_batch({k: (types[k], [list(dict(r[k]).items()) if k == "fields" else r[k] for r in rows]) for k in (x.split()[0] for x in RECORD.split(", "))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((name, part) for batch in batches for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, own in groupby(parts, key=lambda x: x[0]):
            rows, size = [], 0
            for r in parse(x for _, part in own for x in (part.as_py(), SEPARATOR)):
                rows.append(r if payloads else r | {"payload": None})
                size += r["payload_bytes"] if payloads else 0
                if len(rows) == BATCH or size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def parts(files: str, *order: Column) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).option("lineSep", SEPARATOR.decode()).text(path)
        return found.select("_metadata.file_path", F.col("value").cast("binary"), *order)

    plain = parts("*.warc", F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("number"))
    plain = plain.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "number").select("file_path", "value")
    return parts("*.gz").mapInArrow(run, RECORD).union(plain.mapInArrow(run, RECORD))


def captures(found: DataFrame) -> DataFrame:
    """Transactions: one row (capture_id, main, request, requests, metadata) for each response, revisit or resource record.

    A record belongs to the main record that it names in WARC-Concurrent-To, or that names it, or that it reaches over
    the fewest such links, however many; of several the one with the smallest id. requests and metadata are arrays by record id; request is
    the first of requests. Records that reach no main record give a row each with
    a null main. Repeated record ids count once. No records: no rows. `found` is read several times: hand in rows that
    are written or checkpointed."""
    found = found.filter("record_id is not null")
    thin = found.select("record_id", "warc_type", "concurrent_to")
    named = thin.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    edges = named.union(named.select("b", "a")).distinct()
    owners = thin.filter(F.col("warc_type").isin(*MAIN)).select("record_id", F.col("record_id").alias("owner")).distinct()
    rest = thin.filter(~F.col("warc_type").isin(*MAIN)).select("record_id").distinct()
    step = lambda rest, last: rest.join(edges, rest["record_id"] == edges["a"]).select("record_id", "b").join(last.select(F.col("record_id").alias("b"), "owner"), "b").groupBy("record_id").agg(F.min("owner").alias("owner"))
    last = step(rest, owners)
    owners, rest = owners.union(last), rest.join(last, "record_id", "left_anti")
    if not rest.isEmpty():  # links of links: each round is written, until none reaches on
        edges, rest = cut(edges), cut(rest)
        last = cut(last)
        while not last.isEmpty() and not rest.isEmpty():
            last = cut(step(rest, last))
            owners, rest = owners.union(last), cut(rest.join(last, "record_id", "left_anti"))
    owners = owners.union(rest.select("record_id", F.col("record_id").alias("owner")))
    whole = F.struct(*[c for c in found.columns if c not in ("concurrent_to", "fields")], F.map_entries("fields").alias("fields"))
    owned = found.select("record_id", "warc_type", whole.alias("r")).join(owners, "record_id")
    of = lambda kinds: F.col("warc_type").isin(*kinds)
    grouped = owned.groupBy(F.col("owner").alias("capture_id")).agg(
        F.min(F.when(of(MAIN), F.col("r"))).alias("main"), F.array_sort(F.collect_set(F.when(of(["request"]), F.col("r")))).alias("requests"), F.array_sort(F.collect_set(F.when(~of([*MAIN, "request"]), F.col("r")))).alias("metadata")
    )
    return grouped.select("capture_id", "main", F.get("requests", F.lit(0)).alias("request"), "requests", "metadata")


def field_of(metadata: Column, name: str) -> Column:
    """The first value of a field in an array of metadata records."""
    return F.get(F.filter(F.flatten(F.transform(metadata, lambda r: r["fields"])), lambda e: e["key"] == name), F.lit(0))["value"]


def digests(found: DataFrame) -> DataFrame:
    """Captures -> (page_id, payload_bytes, payload_digest, record_type, refers_to); a revisit's payload is the one of the record that it refers to."""
    flat = captures(found).filter("main is not null").select(
        F.col("main.record_id").alias("own"), field_of(F.col("metadata"), "page-id").cast("long").alias("page_id"), F.col("main.payload_bytes").alias("n"), F.col("main.payload_sha1").alias("sha1"), F.col("main.warc_type").alias("record_type"), F.col("main.refers_to").alias("to")
    )
    flat = flat.withColumn("salt", F.pmod(F.hash("own"), F.lit(SALTS)))
    source = flat.filter("record_type = 'response'").select(F.col("own").alias("to"), F.col("page_id").alias("source"), F.col("n").alias("source_n"), F.col("sha1").alias("source_sha1"))
    used = source.join(flat.filter("to is not null").select("to").distinct(), "to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = flat.join(used, ["to", "salt"], "left")
    again = F.col("record_type") == "revisit"
    return joined.select("page_id", F.when(again, F.col("source_n")).otherwise(F.col("n")).alias("payload_bytes"), F.when(again, F.col("source_sha1")).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", F.when(again, F.col("source")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    write(table(spark, sf_dir, "pages"), f"{scratch.path}/warc")
    return digests(scratch.written("records", read(spark, f"{scratch.path}/warc", payloads=False).drop("payload")))  # the archives are parsed once


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest from p),
b as (select payload_digest, max(page_id) as best from d where payload_bytes >= 1000 group by payload_digest)
select d.page_id, payload_bytes, d.payload_digest, case when best <> page_id then 'revisit' else 'response' end as record_type,
  case when best <> page_id then best end as refers_to
from d left join b on b.payload_digest = d.payload_digest and payload_bytes >= 1000
"""
