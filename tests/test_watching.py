"""Watching with a clock of our own, caches, and views over indexes."""

import json
import os

from evigraph.cache import Bounded
from evigraph.operators import metrics
from evigraph.plans import index, observatory
from evigraph.plans.fixtures import FILES
from evigraph.sources import store
from evigraph.streaming.watcher import Backoff, Watcher, difference, fresh


def test_difference_and_backoff():
    assert difference({"A": (1, 1), "gone": (1, 1)}, {"A": (2, 1), "B": (1, 1)}) == {"A": "modified", "B": "added", "gone": "deleted"}
    b = Backoff(0.25, 1.0)
    assert [b.after(False) for _ in range(4)] == [0.25, 0.5, 1.0, 1.0] and b.after(True) == 0.25


def test_watcher_retries(tmp_path):
    now, tree, calls, fail = [0.0], {"a": (1, 1)}, [], [True]

    def refresh(changes):
        calls.append(changes)
        if fail[0]:
            raise RuntimeError("disk")

    w = Watcher(lambda: dict(tree), refresh, str(tmp_path / "status.json"), lambda: now[0], retry=5)
    tree["b"] = (1, 1)
    w.poll()
    assert not calls and json.loads((tmp_path / "status.json").read_text())["pending"] == 1
    now[0] = 0.6
    w.poll()
    assert calls == [{"b": "added"}] and w.state == "degraded" and not fresh(w.status(), now[0])
    fail[0], now[0] = False, 3.0
    w.poll()
    assert len(calls) == 1
    now[0] = 6.0
    w.poll()
    assert calls[-1] == {"b": "added"} and w.state == "idle" and fresh(w.status(), 6.0) and not fresh(w.status() | {"heartbeat": -99}, 6.0)
    assert not fresh({"pid": "x"}, 0) and w.status()["counts"]["error"] == 1 and w.status()["pid"] == os.getpid()


def test_cache():
    c, made = Bounded(2), []
    build = lambda k: lambda: made.append(k) or k
    for k in "abac":
        c.get(k, build(k), 1)
    assert made == ["a", "b", "c"] and (c.stats.hits, c.stats.misses, c.stats.evictions, c.stats.hit_rate()) == (1, 3, 1, 0.25)
    c.get("a", build("a"), 2)
    assert made[-1] == "a" and c.stats.size == 1


def test_observatory(spark, tmp_path):
    root = tmp_path / "tree"
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    s = store.Store(spark, str(tmp_path / "i"))
    index.scan(spark, str(root), s)
    assert observatory.log(s).count() == 0
    observatory.record(s, "context", "r", 12.5, 40, 3, repository_token_estimate=100, cache_hit=True, confidence=0.5)
    observatory.record(s, "scan", "r", 99.0, 0, 0)
    p = observatory.project(s)
    assert p["savings"]["tokens_avoided"] == 60 and p["savings"]["cache_hit_rate"] == 1.0 and p["kinds"]["endpoint"] == 4
    assert (p["health"], p["score"]) == ("attention", 80) and {x["operation"] for x in p["latencies"]} == {"context", "scan"}
    lines = observatory.overview(spark, {"one": s.path, "none": str(tmp_path / "missing")})
    assert lines[0]["files"] == len(FILES) and lines[1]["health"] == "error"
    d = observatory.diagnostics(spark, s, [{"severity": "error", "code": "daemon", "message": "m", "source": "w"}])
    assert metrics.severity_counts(d).first()["error"] == 1
