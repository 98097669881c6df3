"""Answering a task from an index: channels, fusion, packing under a budget, projections and continuation."""

from __future__ import annotations

import copy
import hashlib
import hmac
import json
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.cache import Bounded
from evigraph.functions.classify import requested_tags
from evigraph.functions.scores import graph_score
from evigraph.functions.text import exact_terms
from evigraph.operators import fusion, graph, lookup, packing, search
from evigraph.sources import personas, store

MOST_TASK, TOP_EXACT, TOP_LEXICAL, MOST_NODES = 12_000, 12, 20, 40
MOST_EXACT_CHUNKS, MOST_GRAPH_CHUNKS, MOST_LINES = 100, 160, 24
ECONOMY, CLARIFY, CANDIDATES, TTL = 1400, 400, 3, 45 * 60


def counter(name: str = "generic", path: str | None = None) -> Callable[[str], int]:
    """How tokens are counted: by bytes, or by a public vocabulary's file."""
    if name == "generic":
        return packing.tokens_of
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def held(df: DataFrame) -> DataFrame:
    """The rows of a plan with a limit, as rows at hand: what builds on them doesn't compute them again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def candidates(index: store.Store, task: str, persona: personas.Persona, walk: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fused candidates with their chunks, seeds) as plans; each channel is bounded, so that few hundred rows remain."""
    spark = index.spark
    nodes, edges = index.read("nodes"), index.read("edges")
    names = nodes.select(F.col("node_id").alias("symbol_id"), F.col("qualified_name").alias("symbol"))
    chunks = index.read("chunks").join(names, "symbol_id", "left")
    asked = spark.createDataFrame([("q", task)], "query string, text string")
    terms = asked.select(F.posexplode(exact_terms(F.col("text"))).alias("term_index", "term"))
    real = nodes.filter(~store.of_layer("path"))
    hits = lookup.exact_or_full_text(real, terms, 2 * TOP_EXACT).join(real.select("node_id", "kind", "path"), "node_id")
    if persona.policy.start_kinds:
        hits = lookup.preferred(hits, list(persona.policy.start_kinds))
    seeds = held(hits.orderBy(F.desc("score"), "node_id").limit(TOP_EXACT))
    none = F.lit(None).cast("int")
    in_symbol = chunks.join(F.broadcast(seeds.select(F.col("node_id").alias("symbol_id"), "score")), "symbol_id").select("chunk_id", F.least(F.lit(fusion.MOST_EXACT), "score").alias("score"))
    in_file = chunks.join(F.broadcast(seeds.select("path").distinct()), "path", "left_semi").select("chunk_id", F.lit(fusion.SAME_FILE).alias("score"))
    exact = in_symbol.union(in_file).groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(MOST_EXACT_CHUNKS)
    rows = exact.select("chunk_id", F.lit(0).alias("channel_order"), F.lit("exact-symbol").alias("reason"), "score", none.alias("distance"))
    if "postings" in index.manifest().get("tables", []):
        words = search.search_stored(index.read("postings"), index.read("lengths"), search.CHUNK_WEIGHTS, asked, TOP_LEXICAL)
    else:
        words = search.search(search.chunk_docs(index.read("chunks"), nodes), "chunk_id", search.CHUNK_WEIGHTS, asked, TOP_LEXICAL)
    rows = rows.union(words.select(F.col("doc"), F.lit(1), F.concat(F.lit("fts-rank-"), F.col("rank").cast("string")), F.col("lexical"), none))
    if walk and persona.policy.graph_depth:
        if not persona.policy.traverse_relations:  # the repository would lead from a file to all others
            edges = edges.filter(~(F.col("relation").eqNullSafe("CONTAINS") & store.of_layer("evidence_path")) & (F.col("evidence_path") != "@persona"))
        found = graph.graph_walk(edges, seeds.select("node_id"), list(persona.policy.traverse_relations) or None, min(2, persona.policy.graph_depth), MOST_NODES)
        near = chunks.join(F.broadcast(found.select(F.col("node_id").alias("symbol_id"), "distance", "relation")), "symbol_id")
        near = near.orderBy("distance", "chunk_id").limit(MOST_GRAPH_CHUNKS)
        rows = rows.union(near.select("chunk_id", F.lit(2), F.concat(F.lit("graph:"), "relation"), graph_score(F.col("distance")), F.col("distance")))
    rows = held(rows)
    few = held(chunks.join(F.broadcast(rows.select("chunk_id").distinct()), "chunk_id", "left_semi"))
    wanted = asked.select(requested_tags(F.col("text")).alias("t")).first()["t"]
    rows = rows.union(fusion.tag_boosts(few, ["chunk_id"], wanted, fusion.TASK_TAG, "task-tag", 3)).union(fusion.tag_boosts(few, ["chunk_id"], list(persona.policy.include_tags), fusion.PERSONA_TAG, "persona-tag", 4))
    return fusion.fuse(rows, ["chunk_id"]).join(few, "chunk_id"), seeds


def context(index: store.Store, task: str, persona: str | None = None, profile: str = "auto", budget: int | None = None, exclude: frozenset[str] = frozenset(), clarify: bool = False, known: dict[str, personas.Persona] | None = None, count: Callable[[str], int] = packing.tokens_of) -> dict:
    """The bundle for a task: the best evidence that its budget holds, with scores and reasons."""
    if not task.strip() or len(task) > MOST_TASK:
        raise ValueError(f"a task has 1 to {MOST_TASK} characters")
    spark, known = index.spark, known or personas.registry()
    asked = spark.createDataFrame([("q", task)], "query string, text string")
    routed = personas.route(asked, known).first() if persona is None else None
    sure = routed["confidence"] if routed else 1.0
    who = known[routed["persona"] if routed else persona]
    profile = asked.select(personas.resolve_profile(F.col("text")).alias("p")).first()["p"] if profile == "auto" else profile
    who = personas.apply_profile(who, profile)
    tokens = budget or who.policy.max_context_tokens
    fused, seeds = candidates(index, task, who, walk=not clarify)
    ranked = fusion.above_threshold(fused)
    if exclude:
        ranked = ranked.join(spark.createDataFrame([(x,) for x in exclude], "chunk_id string"), "chunk_id", "left_anti")
    rows = [r.asDict() for r in ranked.orderBy(F.desc(F.round("score", 6)), "chunk_id").collect()]  # few hundred: each channel is bounded
    judged = spark.createDataFrame([("q", k + 1, float(r["score"]), list(r["reasons"])) for k, r in enumerate(rows)], "query string, rank int, score double, reasons array<string>")
    verdict = fusion.assess(judged, asked).first()
    out = {"task": task, "persona": who.id, "profile": profile, "confidence": round(0.25 * sure + 0.75 * (rows[0]["score"] if rows else 0.0), 3), "generation": index.manifest()["generation"], "ambiguous": verdict["ambiguous"], "assessed": verdict["confidence"]}
    if clarify:
        first: dict[str, dict] = {}
        for r in rows:
            first.setdefault(r["path"], r)
        out |= {"kind": "clarification", "recommendation": "ask_user" if verdict["ambiguous"] else "use_context", "candidates": [{"path": r["path"], "lines": f"{r['start_line']}-{r['end_line']}", "symbol": r["symbol"], "score": round(r["score"], 4), "why": list(r["reasons"])} for r in list(first.values())[:CANDIDATES]]}
        return packing.settled(out, CLARIFY, count)
    b = packing.Budget(tokens, who.policy.max_chunks_per_file, count(who.card()))
    for r in rows:
        b.offer(r)
    evidence = []
    for k, r in enumerate(b.chosen):
        lines, why = r["content"].split("\n"), list(r["reasons"]) + ["truncated-to-budget"] * r["truncated"]
        short = k > 0 and r["language"] not in packing.WHOLE and len(lines) > 14
        evidence.append({"id": r["chunk_id"], "path": r["path"], "lines": f"{r['start_line']}-{r['start_line'] + 13 if short else r['end_line']}", "score": round(r["score"], 4), "why": why + ["compressed-secondary-evidence"] * short, "content": "\n".join([*lines[:14], "... [compressed]"]) if short else r["content"]})
    lines = [r["line"] for r in graph.architecture_lines(index.read("nodes"), index.read("edges"), seeds.select("node_id"), MOST_LINES).collect()]
    seeded = not seeds.isEmpty()
    warnings = [w for w, hit in (("no symbol matches the task exactly", not seeded), ("nothing was found", not rows), ("the evidence is weak", bool(rows) and rows[0]["score"] < 0.6), ("tests are asked for, but none was found", "test" in task.lower() and not any("test" in (r["tags"] or []) for r in b.chosen))) if hit]
    return packing.within_budget(out | {"kind": "context", "evidence": evidence, "architecture": lines, "warnings": warnings}, tokens, count)


def economy(bundle: dict) -> dict:
    """The short form of a bundle: keys without a value are left out."""
    e = [{k: x[k] for k in ("path", "lines", "score", "why", "content")} for x in bundle["evidence"]]
    out = {"v": 1, "persona": bundle["persona"], "confidence": bundle["confidence"], "evidence": e, "usage": bundle["usage"] | {"dropped": bundle["dropped"]}}
    return out | {k: bundle[k] for k in ("architecture", "warnings", "continuation") if bundle.get(k)}


def prompt(bundle: dict) -> str:
    """A bundle as text."""
    parts = [f"# {bundle['task']}", f"persona: {bundle['persona']}, confidence: {bundle['confidence']}", *bundle["architecture"]]
    return "\n\n".join([*parts, *(f"## {x['path']}:{x['lines']} ({', '.join(x['why'])})\n{x['content']}" for x in bundle["evidence"])])


def dumps(bundle: dict) -> str:
    return json.dumps(bundle, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass
class Compiler:
    """Answers tasks, and goes on from an answer without what it has given: a token is good for TTL seconds, while the index stays.

    The last 64 answers are kept until the index has another generation."""

    index: store.Store
    clock: Callable[[], float] = time.time
    key: bytes = field(default_factory=lambda: secrets.token_bytes(32))
    held: dict[str, tuple[float, int, frozenset[str], dict]] = field(default_factory=dict)
    answers: Bounded = field(default_factory=lambda: Bounded(64))

    def token(self, task: str, ids: frozenset[str]) -> str:
        return hmac.new(self.key, "\x1f".join([task, *sorted(ids)]).encode(), hashlib.sha256).hexdigest()[:32]

    def ask(self, task: str = "", continuation: str | None = None, **how) -> dict:
        seen: frozenset[str] = frozenset()
        if continuation:
            until, generation, seen, before = self.held.pop(continuation, (0.0, -1, frozenset(), {}))
            if until < self.clock() or generation != self.index.manifest()["generation"]:
                raise KeyError("the continuation has expired")
            task, how = before["task"], before["how"] | how
        asked = (task, seen, *((k, repr(v)) for k, v in sorted(how.items())))
        bundle = copy.deepcopy(self.answers.get(asked, lambda: context(self.index, task, exclude=seen, **how), self.index.manifest()["generation"]))
        ids = seen | {x["id"] for x in bundle.get("evidence", [])}
        if bundle.get("evidence"):
            token = self.token(task, ids)
            self.held[token] = (self.clock() + TTL, bundle["generation"], ids, {"task": task, "how": how})
            bundle["continuation"] = token
        return bundle
