"""Archives: exact round trips, transactions and awkward pages."""

import gzip
import hashlib
import random

import pytest

from evigraph.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes int")


def test_round_trip(spark, tmp_path):
    trap = "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n" * 60
    rows = [(1, "http://a/x y\r\nq", trap), (2, None, trap), (None, None, None), (2, None, trap), (5, "u", ""), (5, "u", ""), (7, "http://h/p?q#f", "x" * 300_000), (8, "http://h/p", "short"), (9, "v", "short")]
    path = str(tmp_path / "out")
    warc.write(pages(spark, [(*r, "clash", 1) for r in rows]), path)
    found = warc.read(spark, path).cache()
    assert found.count() == 3 * len(rows)
    assert sorted(bytes(r["payload"]).decode() for r in found.filter("warc_type = 'response'").collect()) == sorted(["", "", "", trap, "x" * 300_000, "short", "short"])
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digests(found).collect()), key=repr)
    d = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    wanted = [(1, *d(trap), "revisit", 2), (2, *d(trap), "response", None), (2, *d(trap), "revisit", 2), (None, *d(""), "response", None), *[(5, *d(""), "response", None)] * 2, (7, *d("x" * 300_000), "response", None), *[(k, *d("short"), "response", None) for k in (8, 9)]]
    assert got == sorted(wanted, key=repr)
    whole = {warc_row["page"]: warc_row for warc_row in warc.captures(found).select(warc.field_of(warc.F.col("metadata"), "page-id").alias("page"), "main", "request").collect()}
    assert whole["7"]["main"]["target_uri"] == "http://h/p?q#f" and bytes(whole["7"]["main"]["payload"]) == b"x" * 300_000 and whole["7"]["request"]["warc_type"] == "request"


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(pages(spark, []), path)
    assert not warc.digests(warc.read(spark, path)).collect()


def test_transactions_by_links(spark):
    r = lambda i, kind, *to: (i, kind, None, None, list(to), None, None, {}, None, 0, "")
    rows = [r("m1", "response", "q1"), r("q1", "request"), r("d1", "metadata", "q1"), r("m2", "revisit"), r("q2", "request", "m2"), r("d2", "metadata", "m2"), r("d3", "metadata", "m2"), r("lost", "metadata", "nowhere"), r("m3", "resource")]
    found = spark.createDataFrame([*rows, rows[1]], warc.RECORD)
    got = {c["capture_id"]: (c["main"] and c["main"]["record_id"], c["request"] and c["request"]["record_id"], [x["record_id"] for x in c["metadata"]]) for c in warc.captures(found).collect()}
    assert got == {"m1": ("m1", "q1", ["d1"]), "m2": ("m2", "q2", ["d2", "d3"]), "m3": ("m3", None, []), "lost": (None, None, ["lost"])}


def test_several_requests(spark):
    r = lambda i, kind, *to: (i, kind, None, None, list(to), None, None, {}, None, 0, "")
    rows = [r("m", "response"), r("q2", "request", "m"), r("q1", "request", "m"), r("n", "resource")]
    got = {c["capture_id"]: (c["request"] and c["request"]["record_id"], [x["record_id"] for x in c["requests"]]) for c in warc.captures(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"m": ("q1", ["q1", "q2"]), "n": (None, [])}


def test_plain_archives_in_splits(spark, tmp_path):
    """Plain archives are cut into many splits, in the middle of records too."""
    rng = random.Random(3)
    bodies = [[bytes(rng.choice(b"ab\r\n\xff") for _ in range(rng.randrange(400))) + rng.choice([b"", b"\r\n\r\n"]) for _ in range(60)] for _ in range(3)]
    for k, own in enumerate(bodies):
        records = [b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <%d-%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, n, len(b), b) for n, b in enumerate(own)]
        (tmp_path / f"{k}.warc").write_bytes(b"".join(records))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(records[0]))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = warc.read(spark, str(tmp_path))
        got = sorted((r["record_id"], bytes(r["payload"])) for r in found.collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    wanted = [(f"<{k}-{n}>", b) for k, own in enumerate(bodies) for n, b in enumerate(own)]
    assert got == sorted([*wanted, ("<2-0>", bodies[2][0])])


def test_long_chains_of_links(spark):
    r = lambda i, kind, *to: (i, kind, None, None, list(to), None, None, {}, None, 0, "")
    rows = [r("m", "response")] + [r(f"d{k}", "metadata", f"d{k - 1}" if k else "m") for k in range(6)] + [r("x1", "metadata", "x2"), r("x2", "metadata", "x1")]
    got = {c["capture_id"]: len(c["metadata"]) for c in warc.captures(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"m": 6, "x1": 1, "x2": 1}


def test_parser(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nX: 1\r\n 2\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    empty = one.replace(b"Length: 3", b"Length: 0").replace(b"abc", b"")
    binary = one.replace(b"Length: 3", b"Length: 12").replace(b"abc", b"\xff\r\n\r\n\x00\xfeWARC/")
    for n in (1, 2, 7, 1000):
        data = one + empty + binary + one
        assert [x["payload"] for x in warc.parse(data[k : k + n] for k in range(0, len(data), n))] == [b"abc", b"", b"\xff\r\n\r\n\x00\xfeWARC/", b"abc"]
        assert not list(warc.parse([])) and not list(warc.parse([b"\r\n", b"\r\n"]))
    for bad in (one[:-6], b"junk", one + b"junk", b"WAR", one + b"\r"):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(binary))  # a member for each record
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(empty + one))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b""))
    assert sorted(bytes(r["payload"]) for r in warc.read(spark, str(tmp_path)).collect()) == sorted([b"abc", b"abc", b"", b"\xff\r\n\r\n\x00\xfeWARC/"])
