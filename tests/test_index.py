"""An index from end to end: scanning, refreshing, failing files, answering and evaluating."""

import subprocess

import pytest
from pyspark.sql import functions as F

from evigraph.operators import evaluate, resolve, search
from evigraph.plans import context, harness, index
from evigraph.plans.fixtures import FILES
from evigraph.sources import files, personas, store

MORE = {
    "shop/OrderServiceTest.java": "package com.shop.core;\n\npublic class OrderServiceTest {\n    public void loads() {\n    }\n}\n",
    "shop/OrderRepository.java": "package com.shop.core;\n\npublic interface OrderRepository {\n    public abstract Order findById(String id);\n}\n",
    "README.md": "# Shop\nOrders are kept.\n\n## User Authentication\nUsers sign in.\n",
    "broken.py": "class Broken:\n    pass\n",
}


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def rows(s, table):
    df = s.read(table)
    return {tuple(str(v) for k, v in sorted(r.asDict().items()) if k not in ("mtime",)) for r in df.collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "repo"
    write(root, FILES | MORE)
    s = store.Store(spark, str(tmp_path_factory.mktemp("index") / "i"))
    return root, s, index.scan(spark, str(root), s)


def test_scan(built, spark):
    root, s, report = built
    assert report["changed"] == len(FILES | MORE) and not report["failed"]
    edges = {(e["source_id"], e["relation"], e["target_id"]) for e in s.read("edges").collect()}
    assert ("java::com.shop.web.OrderController", "RESOLVED_DEPENDS_ON", "java::com.shop.core.OrderService") in edges
    assert ("java::com.shop.core.OrderServiceTest", "TESTS", "java::com.shop.core.OrderService") in edges
    assert {t for s_, r, t in edges if r == "CONTAINS" and s_.startswith("repo::")} == {n["node_id"] for n in s.read("nodes").filter("kind = 'file'").collect()}
    assert ("generic::client/orders.ts::method::place", "RESOLVED_CALLS_ENDPOINT", "endpoint::com.shop.web.OrderController::find/1::GET /api/orders/{}") in edges
    tags = {t for c in s.read("chunks").filter("path = 'README.md'").collect() for t in c["tags"]}
    assert {"markdown", "section:authentication"} <= tags
    assert index.status(s)["tables"]["files"] == len(FILES | MORE)


def test_answers(built):
    _, s, _ = built
    b = context.context(s, "Fix OrderService load of orders")
    assert b["evidence"][0]["path"] == "shop/OrderService.java" and "exact-symbol" in b["evidence"][0]["why"] and b["persona"] == "debugger"
    assert b["usage"]["tokens"] == context.packing.tokens_of(context.dumps(b)) <= b["usage"]["budget"]
    assert any("OrderController --RESOLVED_DEPENDS_ON--> OrderService" in x for x in b["architecture"])
    assert set(context.economy(b)) >= {"v", "evidence", "usage"} and "shop/OrderService.java" in context.prompt(b)
    c = context.context(s, "something", clarify=True)
    assert c["kind"] == "clarification" and c["ambiguous"] and c["recommendation"] == "ask_user" and "evidence" not in c
    with pytest.raises(ValueError):
        context.context(s, " ")


def test_stored_postings(built, spark):
    """The stored index gives what splitting all texts gives, and the words reach its scan."""
    _, s, _ = built
    asked = spark.createDataFrame([("a", "order service load"), ("b", "users sign in"), ("c", "nowhere_at_all"), ("d", "OrderRepository.findById")], "query string, text string")
    docs = search.chunk_docs(s.read("chunks"), s.read("nodes"))
    stored = search.search_stored(s.read("postings"), s.read("lengths"), search.CHUNK_WEIGHTS, asked)
    got = {tuple(r) for r in stored.collect()}
    assert got == {tuple(r) for r in search.search(docs, "chunk_id", search.CHUNK_WEIGHTS, asked).collect()} and {r[0] for r in got} == {"a", "b", "d"}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "In(tok, [" in plan


def test_refreshed_postings_split_changed_texts_alone(spark):
    old = spark.createDataFrame([("1", "a b", "x"), ("2", "c", None), ("3", "", "c"), ("4", "gone", "")], "k string, body string, title string")
    new = spark.createDataFrame([("1", "a b", "x"), ("2", "c d", None), ("3", "c", ""), ("5", None, "new")], "k string, body string, title string")
    columns = ["body", "title"]
    before = search.refreshed(old, "k", columns)
    marked = before[0].withColumn("pos", F.col("pos") + 100)  # rows that are taken over can be told
    postings, lengths = search.refreshed(new, "k", columns, (marked, before[1]))
    whole = search.refreshed(new, "k", columns)
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, whole[1].collect()))
    assert {r["doc"] for r in postings.filter("pos >= 100").collect()} == {"1"}
    assert {(r["doc"], r["col"], r["pos"] % 100, r["tok"]) for r in postings.collect()} == {tuple(r) for r in whole[0].select("doc", "col", "pos", "tok").collect()}


def test_continuation(built):
    _, s, _ = built
    now = [0.0]
    c = context.Compiler(s, clock=lambda: now[0])
    a = c.ask("orders service repository controller", budget=500)
    b = c.ask(continuation=a["continuation"])
    assert not {x["id"] for x in a["evidence"]} & {x["id"] for x in b["evidence"]}
    with pytest.raises(KeyError):
        c.ask(continuation=a["continuation"])
    d = c.ask("orders", budget=500)
    now[0] = context.TTL + 1
    with pytest.raises(KeyError):
        c.ask(continuation=d["continuation"])


def test_evaluation(built, spark):
    _, s, _ = built
    cases = spark.createDataFrame([("1", "Fix OrderService load", "debugger", ["OrderService.java"], ["broken.py"], None, ["load", "NoSuchThing"], ["source", "database"]), ("2", "Document the README", "doc-writer", ["README.md"], [], "eco", [], ["documentation"])],
        "id string, query string, expected_persona string, expected_files array<string>, forbidden_files array<string>, profile string, expected_symbols array<string>, expected_context_types array<string>")
    per_case, total = harness.run(s, cases)
    t = total.first()
    assert {r["case"]: (r["symbol_recall"], r["context_type_recall"]) for r in per_case.collect()} == {"1": (0.5, 0.5), "2": (None, 1.0)}
    assert (t["symbol_recall"], t["context_type_recall"]) == (0.5, 0.75)
    assert {r["metric"]: r["passed"] for r in evaluate.gates(total).collect()}["symbol_recall"] is False
    assert (t["routing_accuracy"], t["file_recall"], t["forbidden_hits"]) == (1.0, 1.0, 0) and t["mrr"] >= 0.75
    got = harness.timings(s, {"read": lambda: s.manifest()}, runs=2).collect()
    assert {r["operation"] for r in got} == {"read:cold", "read:warm"}


def test_refresh_equals_full(built, spark, tmp_path):
    root, s, _ = built
    (root / "shop/OrderService.java").write_text(FILES["shop/OrderService.java"].replace("load(", "fetch(").replace("orders.limit", "orders.most"))
    (root / "api/users.py").unlink()
    (root / "extra.py").write_text("import os\n\n\ndef added():\n    return 1\n")
    mine = {"tester": personas.Persona("tester", ("test",), policy=personas.Policy(traverse_relations=("TESTS",), start_kinds=("class",)))}
    report = index.scan(spark, str(root), s, known=mine)
    assert (report["changed"], report["deleted"]) == (2, 1)
    assert {r["node_id"] for r in s.read("nodes").filter("path = '@persona'").collect()} == {"persona::tester", "relation::TESTS", "kind::class"}
    other = store.Store(spark, str(tmp_path / "full"))
    index.scan(spark, str(root), other, known=mine)
    for table in ("files", "nodes", "edges", "chunks", "postings", "lengths"):
        assert rows(s, table) == rows(other, table), table


def test_git_names_what_changed(spark, tmp_path, monkeypatch):
    root = tmp_path / "git"
    write(root, {"a.py": "def f():\n    pass\n"})
    for args in (("init", "-q"), ("add", "-A"), ("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x")):
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)
    s = store.Store(spark, str(tmp_path / "i"))
    assert not index.scan(spark, str(root), s)["skipped"]
    assert index.scan(spark, str(root), s)["skipped"]
    (root / "b.py").write_text("import a\n\n\ndef g():\n    pass\n")
    (root / "sub").mkdir()
    (root / "a.py").rename(root / "sub/c.py")
    (root / "_hidden.py").write_text("x = 1\n")
    asked, listing = [], files.listing
    monkeypatch.setattr(files, "listing", lambda *a, **k: asked.append(k["changed"]) or listing(*a, **k))
    assert {k: v for k, v in index.scan(spark, str(root), s).items() if k in ("changed", "deleted")} == {"changed": 2, "deleted": 1}
    assert set(asked[0]) == {"b.py", "_hidden.py", "sub/c.py"}  # Git named them
    (root / "sub/d[1].py").write_text("x = 1\n")  # a name that the reader would take for a pattern
    assert {r["path"] for r in listing(spark, str(root), changed=["sub/d[1].py", "b.py", "gone.py"]).select("path").collect()} == {"sub/d[1].py", "b.py"}
    (root / "sub/d[1].py").unlink()
    other = store.Store(spark, str(tmp_path / "full"))
    index.scan(spark, str(root), other)
    for table in ("files", "nodes", "edges", "chunks"):
        assert rows(s, table) == rows(other, table), table
    checked = index.doctor(s, str(root))
    assert checked["workspace"] and checked["repository"] and checked["index"] and not checked["degraded"]


def test_layers_and_owners(spark):
    node = "node_id string, kind string, name string, qualified_name string, path string, start_line int, end_line int, metadata string"
    layer = lambda x: '{"layer": "%s"}' % x
    nodes = spark.createDataFrame([(n, "class", n, f"p.{n}", f"{n}.java", 1, 9, layer(w)) for n, w in (("C", "controller"), ("D", "controller"), ("S", "service"), ("T", "service"), ("R", "repository"), ("Q", "repository"))] + [("e::p.R", "external_symbol", "R", "p.R", None, 0, 0, "{}"), ("e::z.N", "external_symbol", "N", "z.N", None, 0, 0, "{}")], node)
    edge = "source_id string, relation string, target_id string, evidence_path string, confidence double"
    resolved = spark.createDataFrame([(a, "RESOLVED_DEPENDS_ON", b, f"@derived:{a}.java", 0.9) for a, b in (("C", "S"), ("C", "T"), ("D", "R"), ("T", "R"), ("T", "Q"))], edge)
    more_nodes, more_edges = index.structure(nodes, resolved, "repo::x", "x")
    assert {r["node_id"] for r in more_nodes.collect()} == {"repo::x", "pattern::layered::C"}
    got = {(r["source_id"], r["relation"], r["target_id"], r["evidence_path"]) for r in more_edges.collect()}
    assert got == {("C", "FOLLOWS_PATTERN", "pattern::layered::C", "@derived:C.java")} | {("pattern::layered::C", "HAS_MEMBER", m, "@derived:C.java") for m in "CSTRQ"}
    raw = spark.createDataFrame([("S", "DEPENDS_ON", "e::p.R"), ("T", "CALLS", "e::z.N"), ("C", "IMPORTS", "e::p.R")], "source_id string, relation string, target_id string")
    owners = lambda rows: {r["path"] for r in resolve.affected_owners(raw, nodes, spark.createDataFrame(rows, "kind string, name string, qualified_name string")).collect()}
    assert owners([("class", "R", "other.R")]) == {"S.java"}  # by the simple name
    assert owners([("class", "n", None), ("class", None, "P.r")]) == {"S.java", "T.java"} and owners([("class", "X", "p.X")]) == set()


def test_resolve_makes_no_pairs_of_a_shared_name(spark, tmp_path):
    """1,000 references and 1,000 nodes with one name: the joins make a row for each reference, not a million."""
    nodes = spark.range(1000).selectExpr("concat('n', id) as node_id", "'part' as kind", "concat('b.', id) as qualified_name", "'same' as name")
    nodes = nodes.union(spark.createDataFrame([("one", "part", "b.one", "one")], nodes.schema))
    refs = spark.range(1000).selectExpr("concat('r', id) as ref", "'DEPENDS_ON' as relation", "'x.same' as qualified_name")
    refs = refs.union(spark.createDataFrame([("r1000", "DEPENDS_ON", "x.one"), ("twice", "DEPENDS_ON", "x.one"), ("twice", "DEPENDS_ON", "x.same"), ("again", "DEPENDS_ON", "x.one"), ("again", "DEPENDS_ON", "y.one"), ("q", "EXTENDS", "B.7")], refs.schema))
    for k, df in (("refs", refs), ("nodes", nodes)):  # files, so that Spark can't work out the rows beforehand
        df.write.parquet(str(tmp_path / k))
    found = resolve.resolve(spark.read.parquet(str(tmp_path / "refs")), spark.read.parquet(str(tmp_path / "nodes"))).collect()
    assert {tuple(r) for r in found} == {("r1000", "one", "simple"), ("again", "one", "simple"), ("q", "n7", "qualified")}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    log = spark._jsparkSession.sharedState().statusStore()
    last = log.executionsList().last()
    values = log.executionMetrics(last.executionId())
    nodes_run = log.planGraph(last.executionId()).allNodes()
    made = 0
    for node in (nodes_run.apply(i) for i in range(nodes_run.size())):
        for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                made += int(values.apply(m.accumulatorId()).replace(",", ""))
    assert 1000 <= made < 10_000
