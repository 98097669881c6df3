"""Lookup, walks, packing, personas, files and streams."""

import json
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from evigraph.operators import chunking, evaluate, export, graph, lookup, metrics, packing, search
from evigraph.plans import catalog
from evigraph.sources import datasets, files, personas
from evigraph.streaming.changes import Coalescer, coalesce_stream, coalesced, sessions, timed, windowed


def test_lookup(spark):
    n = spark.createDataFrame([("j::A", "class", "PaymentService", "com.acme.PaymentService", "a/A.java"), ("j::B", "class", "Payment", "com.acme.Payment", "payments/B.java"), ("j::C", "class", "Other", "payment.Other", None)], "node_id string, kind string, name string, qualified_name string, path string")
    t = spark.createDataFrame([(0, "Payment"), (1, " "), (2, "PAYMENTSERVICE")], "term_index int, term string")
    assert {(r["term_index"], r["node_id"]): r["score"] for r in lookup.term_hits(n, t).collect()} == {(0, "j::A"): 0.85, (0, "j::B"): 1.0, (0, "j::C"): 0.8, (2, "j::A"): 1.0}
    assert [(r["node_id"], r["score"]) for r in lookup.exact_nodes(n, t).collect()] == [("j::B", 1.0), ("j::A", 1.0), ("j::C", 0.8)]


def test_full_text_finds_words_inside_names(spark):
    n = spark.createDataFrame([("j::A", "class", "A", "com.acme.Payment", "src/a/A.java"), ("j::B", "class", "acme", "acme", "b/B.java"), ("j::C", "class", "C", "x.C", "c")], "node_id string, kind string, name string, qualified_name string, path string")
    t = spark.createDataFrame([(0, "acme"), (1, "paym")], "term_index int, term string")
    assert [r["node_id"] for r in lookup.exact_nodes(n, t).collect()] == ["j::B"]
    got = {r["node_id"]: r["score"] for r in lookup.exact_or_full_text(n, t).collect()}
    assert set(got) == {"j::A", "j::B"} and got["j::B"] == 1.0 and 0.6 < got["j::A"] < 0.7
    assert [r["node_id"] for r in lookup.exact_or_full_text(n, t, 1).collect()] == ["j::B"]


def test_walk(spark):
    e = [("root", "D", f"c{i}") for i in range(5)] + [(f"c{i}", "D", f"l{i}") for i in range(5)] + [("x", "A", "root")]
    df = spark.createDataFrame(e, "source_id string, relation string, target_id string")
    s = spark.createDataFrame([("root",)], "node_id string")
    got = {r["node_id"]: (r["distance"], r["relation"]) for r in graph.graph_walk(df, s, ["D"], 2, 20).collect()}
    assert sum(v[0] == 1 for v in got.values()) == 5 == sum(v[0] == 2 for v in got.values()) and "x" not in got
    assert [r["node_id"] for r in graph.graph_walk(df, s, None, 2, 3).orderBy("node_id").collect()] == ["c0", "c1", "x"]
    assert graph.graph_walk(df, s, ["none"]).count() == 0
    assert {(r["node_id"], r["distance"]) for r in graph.reach(df, s, 2).collect()} == {(k, v[0]) for k, v in got.items()} | {("x", 1)}
    loop = spark.createDataFrame([("a", "R", "a")], "source_id string, relation string, target_id string")
    assert graph.degrees(spark.createDataFrame([("a",), ("b",)], "node_id string"), loop).orderBy("node_id").collect()[0]["degree"] == 2


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the order service"), (2, "pay by card"), (3, "order order")], "id long, content string")
    path = str(tmp_path / "index")
    search.write_index(docs, "id", ["content"], path, 2)
    q = spark.createDataFrame([("a", "order"), ("b", "card service")], "query string, text string")
    stored = search.top(search.bm25(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), search.phrases(q), {"content": 1.0}))
    direct = search.search(docs, "id", {"content": 1.0}, q)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect())) and stored.count() == 4


def test_chunks(spark):
    f = spark.createDataFrame([("g.md", "markdown", "# One\n" + "x\n" * 5 + "## User Authentication\n" + "y\n" * 6), ("e", "text", ""), ("p", "text", "\n".join(map(str, range(1, 26))))], "path string, language string, content string")
    got = {(r["path"], r["start_line"], r["end_line"]): r["tags"] for r in chunking.heading_sections(f).collect()}
    assert set(got) == {("g.md", 1, 6), ("g.md", 7, 13), ("p", 1, 25)} and "section:authentication" in got["g.md", 7, 13]
    w = [(r["start_line"], r["end_line"]) for r in chunking.line_windows(f, 10, 3).filter("path = 'p'").orderBy("start_line").collect()]
    assert w == [(1, 10), (8, 17), (15, 24), (22, 25)]


def test_greedy_pack(spark):
    text = "x" * 360
    rows = [("q", "a", 1, 10, text, 0.9, 1), ("q", "a", 2, 9, text, 0.8, 2), ("q", "a", 20, 30, text, 0.7, 3), ("q", "a", 40, 50, text, 0.6, 4), ("q", "b", 1, 9, "y" * 3600, 0.5, 5), ("q", "c", 1, 1, "z", 0.4, 6), ("r", "big", 1, 1, "w" * 9000, 1.0, 1)]
    df = spark.createDataFrame(rows, "query string, path string, start_line int, end_line int, content string, score double, rank int")
    got = {(r["query"], r["path"], r["start_line"]): r for r in packing.greedy_pack(df, 400, 2).collect()}
    assert set(got) == {("q", "a", 1), ("q", "a", 20), ("q", "c", 1), ("r", "big", 1)}
    assert got["r", "big", 1]["truncated"] and got["r", "big", 1]["content"].endswith("[truncated]")


def test_budget_fixpoint():
    bundle = {"task": "t" * 100, "evidence": [{"content": "x" * 400} for _ in range(5)], "architecture": ["a --R--> b"] * 3}
    out = packing.within_budget(bundle, 300)
    text = json.dumps({k: v for k, v in out.items()}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert out["usage"]["tokens"] == packing.tokens_of(text) <= 300 and out["dropped"] == 5 - len(out["evidence"]) > 0
    with pytest.raises(packing.TokenBudgetError):
        packing.within_budget(bundle, 10)


@pytest.mark.parametrize(("task", "persona"), [("Review this pull request", "reviewer"), ("Write unit tests for X", "tester"), ("Fix the crash", "debugger"), ("Document this module", "doc-writer"), ("Explain the architecture", "architect"), ("hello", "developer")])
def test_routing(spark, task, persona):
    r = personas.route(spark.createDataFrame([("q", task)], "query string, text string")).first()
    assert r["persona"] == persona and (r["confidence"] > 0) == (task != "hello")


def test_profiles(spark, tmp_path):
    p = personas.apply_profile(personas.Persona("x", ()), "eco").policy
    assert (p.max_context_tokens, p.max_chunks_per_file, p.graph_depth) == (1800, 2, 1)
    with pytest.raises(ValueError):
        personas.apply_profile(personas.Persona("x", ()), "none")
    (tmp_path / "a.json").write_text(json.dumps({"id": "tester", "triggers": ["zap"], "rules": list("abcdef"), "retrieval": {"traverse_relations": ["CALLS"], "graph_depth": 5}}))
    mine = personas.registry(*personas.load(str(tmp_path)))
    assert mine["tester"].triggers == ("zap",) and mine["tester"].card().count("\n") == 4
    assert [(r["source_id"], r["target_id"]) for r in personas.policy_edges(spark, {"tester": mine["tester"]}).collect()] == [("persona::tester", "relation::CALLS")]
    with pytest.raises(ValueError):
        personas.registry(base={"x": ()})


def test_profile_apply_reads_words_as_its_sql_does(spark, tmp_path):
    """A word ends before an accented letter, a vertical tab is no space, İ is i; tasks as context() takes them keep their own words."""
    words = " ".join("abcdefghijkl")
    texts = ["Queí se", "éAbc", "Abc\u0301", "Abc déf", "Ab é", f"Abc {words}", f"Abc\x0b{words}", f"Abc {words}".replace(" l", "\x0bl"), "MİGRATİON of Abc", "croß-module", "", "\x0b", None]
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r["profile"] for r in catalog.QUERIES["profile_apply"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        wanted = c.sql(catalog.SQL["profile_apply"]).df()
    assert found == dict(zip(wanted["conv_id"], wanted["profile"], strict=True))
    assert [found[k] for k in range(9)] == ["eco", "eco", "eco", "eco", "balanced", "balanced", "eco", "eco", "deep"]
    assert spark.createDataFrame([("Abc\x0b" + words,)], "text string").select(personas.resolve_profile(F.col("text"))).first()[0] == "balanced"


def test_evaluation(spark, tmp_path):
    got = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("c", "a", 3), ("d", "x", 1)], "case string, item string, rank int")
    want = spark.createDataFrame([("c", "b"), ("c", "z"), ("e", "q")], "case string, item string")
    rows = {r["case"]: tuple(r)[1:] for r in evaluate.cases(got, want, spark.createDataFrame([("d", "x")], "case string, item string")).collect()}
    assert rows == {"c": (0.5, 0.5, 0.5, 0), "d": (0.0, None, None, 1), "e": (None, 0.0, 0.0, 0)}
    path = tmp_path / "set.json"
    path.write_text(json.dumps([{"id": "1", "query": "q", "expected_files": ["a"]}]))
    assert datasets.load(spark, str(path)).first()["expected_files"] == ["a"]
    for bad in ({"schema_version": 2, "cases": []}, {"schema_version": 1, "cases": [{"id": "1", "zzz": 1}]}, {"schema_version": 1, "cases": [{"expected_context_types": ["x"]}]}):
        with pytest.raises(datasets.DatasetError):
            datasets.parse(json.dumps(bad))
    assert datasets.schema()["properties"]["schema_version"] == {"const": 1}


def test_savings_defaults(spark):
    c = spark.createDataFrame([(10, None, True, None), (600, 100, False, 0.5)], "delivered long, baseline long, cache_hit boolean, confidence double")
    r = metrics.savings(c, [], F.lit(400)).first()
    assert (r["baseline_tokens"], r["tokens_delivered"], r["tokens_avoided"], r["average_confidence"], r["cache_hit_rate"]) == (500, 610, 0, 0.5, 0.5)


def test_exports(spark, tmp_path):
    n = spark.createDataFrame([("b", "k", "B<1>"), ("a", "k", 'A"q"')], "node_id string, kind string, qualified_name string")
    e = spark.createDataFrame([("a", "R", "b")], "source_id string, relation string, target_id string")
    export.write(export.mermaid(n, e), str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["graph LR", "    n1[\"A'q'\"]", '    n2["B<1>"]', "    n1 -->|R| n2"]
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring("\n".join(r["line"] for r in export.graphml(n, e).orderBy("line_no").collect()))[0]) == 3
    assert len(export.json_lines(n, e).collect()) == 3


def test_file_source(spark, tmp_path):
    root = tmp_path / "repo"
    for path, data in {"a/A.java": b"class A {}", "b.py": b"x = '\xff'\napi_key = \"abcdefgh1234\"\n", "big.py": b"#" * 2000, "skip/c.py": b"1", "logo.png": b"x", ".env": b"", "keep.log.py": b"1", "other.log.py": b"1", "z.key": b"1"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)
    listed = files.listing(spark, str(root), most_bytes=1000, ignore=("skip/", "*.log.py", "!keep.log.py"))
    assert {r["path"] for r in listed.select("path").collect()} == {"a/A.java", "b.py", "keep.log.py"}
    read = {r["path"]: r for r in files.read_files(listed).collect()}
    assert read["b.py"]["warnings"] == ["undecodable bytes were replaced", "redacted generic_secret"] and "<REDACTED:generic_secret>" in read["b.py"]["content"] and read["a/A.java"]["language"] == "java"
    assert files.listing(spark, str(root), changed=["b.py"]).count() == 1
    assert set(files.snapshot(listed).columns) == {"path", "size", "mtime"}


@pytest.mark.parametrize(("pattern", "path", "ignored"), [("node_modules/", "a/node_modules/x.js", True), ("*.pem", "a/b.pem", True), ("/build", "build/x", True), ("/build", "a/build/x", False), ("docs/**", "docs/a/b.md", True), ("**/tmp/*.py", "a/tmp/x.py", True), ("a?c", "abc", True), ("[ab].py", "b.py", True), ("# no", "# no", False)])
def test_ignore(pattern, path, ignored):
    assert files.Ignore((pattern,)).matches(path) is ignored


def test_the_tree_s_own_ignore_file(spark, tmp_path):
    for name in ("a.py", "node_modules/x/b.js", "keep.log.py", "build/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    listed = lambda **how: {r["path"] for r in files.listing(spark, str(tmp_path), **how).select("path").collect()}
    assert {"a.py", "node_modules/x/b.js", "build/c.py"} <= listed()
    (tmp_path / ".gitignore").write_text("# not these\nnode_modules/\n/build\n")
    assert listed() == {"a.py", "keep.log.py"} and listed(changed=["a.py", "build/c.py"]) == {"a.py"}


def test_greedy_pack_reads_on(spark):
    """Rows far beyond what fits come in later batches, and smaller ones that still fit are taken."""
    rows = [("q", f"p{k}", 1, 9, "x" * (700 if k % 500 else 40), 1.0, k) for k in range(25_000)] + [(None, "n", 1, 2, "y", 1.0, 1)]
    got = packing.greedy_pack(spark.createDataFrame(rows, "query string, path string, start_line int, end_line int, content string, score double, rank int"), 400).collect()
    b = packing.Budget(400)
    for r in rows[:25_000]:
        b.offer(dict(zip(("query", "path", "start_line", "end_line", "content", "score", "rank"), r, strict=True)))
    assert sorted(r["path"] for r in got if r["query"] == "q") == sorted(x["path"] for x in b.chosen) and sum(r["query"] is None for r in got) == 1


def test_git_changes(tmp_path):
    root = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    for name in ("a.py", "b.py", "c.py"):
        (tmp_path / name).write_text(name * 20)
    git("add", "-A")
    git("commit", "-qm", "one")
    first = git("rev-parse", "HEAD")
    git("mv", "a.py", "moved.py")
    git("commit", "-qm", "two")
    (tmp_path / "b.py").write_text("dirty")
    (tmp_path / "c.py").unlink()
    (tmp_path / "new.py").write_text("n")
    got = files.git_changes(root, first)
    assert got.changed == {"moved.py", "b.py", "new.py"} and got.deleted == {"a.py", "c.py"}
    (tmp_path / ".gitignore").write_text("x")
    assert files.git_changes(root, first) is None
    assert files.repository_id(root).startswith("repo::")


def test_coalescer(spark):
    c = Coalescer(0.5, 2)
    c.push("A", "added", 0.0)
    for p, x in (("A", "modified"), ("B", "modified"), ("gone", "deleted")):
        c.push(p, x, 0.2)
    assert not c.ready(0.6) and c.ready(0.71)
    assert c.flush() == {"A": "added", "B": "modified", "gone": "deleted"} and not c.ready(99)
    c = Coalescer(1, 2)
    c.push("A", "modified", 0)
    c.push("B", "modified", 1.5)
    assert not c.ready(1.9) and c.ready(2.0)
    c = Coalescer(1, 2)
    c.push("x", "added", 0)
    c.push("x", "deleted", 0.1)
    assert c.due() is None
    df = spark.createDataFrame([("r", "a", "deleted", 0.0), ("r", "a", "added", 0.1), ("r", "b", "added", 9.0), ("s", "c", "added", 0.0)], "repository string, path string, change string, at double")
    assert {tuple(r) for r in coalesced(df, 0.5, 2).collect()} == {("r", 0.6, "a", "modified"), ("r", 9.5, "b", "added"), ("s", 0.5, "c", "added")}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r", "a", "added", 0.0), ("r", "a", "modified", 0.1)], "repository string, path string, change string, at double").write.parquet(src)
    stream = coalesce_stream(spark.readStream.schema("repository string, path string, change string, at double").parquet(src), 0.2, 1.0)
    q = stream.writeStream.format("memory").queryName("flushed").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        import time

        end = time.time() + 60
        while time.time() < end and not spark.sql("select * from flushed").count():
            time.sleep(0.3)
        assert [(r["path"], r["change"]) for r in spark.sql("select * from flushed").collect()] == [("a", "added")]
    finally:
        q.stop()


def test_event_windows_stream_as_in_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(400)
    path = str(tmp_path / "events")
    events.write.parquet(path)
    batch = {tuple(r) for r in windowed(timed(spark.read.parquet(path), "ts"), "1 day").select("start", "event_type", "n").collect()}
    q = windowed(timed(spark.readStream.schema(events.schema).parquet(path), "ts", "1 hour"), "1 day").select("start", "event_type", "n").writeStream.format("memory").queryName("days").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from days").collect()} == batch
    finally:
        q.stop()
    assert sessions(timed(events, "ts"), "30 minutes").agg(F.sum("n")).first()[0] == 400
