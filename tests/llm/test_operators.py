"""Operators on awkward rows and empty tables: each row of the input has its row in the result."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from evigraph.llm import components, hmm, langid, mixing, nearcopies, packing, pii, quality, repetition, simhash, sketches


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="session")
def rows(awkward):
    return [(r["doc_id"], r["text"]) for r in awkward.collect()]


def test_simhash_against_brute_force(docs, awkward, empty, rows):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for df, some in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (awkward, [(i, t) for i, t in rows if t is None or len(t) < 50_000] )):
        if df is awkward:
            df = df.filter("text is null or length(text) < 50000")
        found = collected(simhash.near_duplicates(df))
        prints = [(i, brute(t)) for i, t in some]
        assert Counter((r["doc_id"], r["fingerprint"]) for r in found) == Counter((i, f"{f:016x}") for i, f in prints)
        group = {f: f for _, f in prints}
        changed = True
        while changed:
            changed = False
            for a in group:
                for b in group:
                    if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                        group[a] = group[b] = min(group[a], group[b])
                        changed = True
        least = defaultdict(list)
        for i, f in prints:
            if i is not None:
                least[group[f]].append(i)
        assert Counter((r["fingerprint"], r["component_id"]) for r in found) == Counter((f"{f:016x}", min(least[group[f]], default=None)) for _, f in prints)
    assert not collected(simhash.near_duplicates(empty))


def test_simhash_links_large_groups(spark):
    """Groups over the limits, and pairs at every distance: forests and blocks join what pairs would."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 200)}
    fps |= {f ^ (1 << 3) ^ (1 << 40) ^ (1 << 63) for f in list(fps)[:80]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def components(edges):
        at = {f: f for f in signed}

        def root(x):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in edges:
            at[root(a)] = root(b)
        return {frozenset(f for f in signed if root(f) == r) for r in {root(f) for f in signed}}

    wanted = components([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    for small, large in ((64, 20_000), (2, 20_000), (2, 3), (2, 20)):
        old = simhash.SMALL, simhash.LARGE
        simhash.SMALL, simhash.LARGE = small, large
        try:
            found = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
        finally:
            simhash.SMALL, simhash.LARGE = old
        assert components(found) == wanted


def test_pigeonring_misses_no_pair():
    rng = np.random.default_rng(1)
    masks = np.array(simhash.key_masks(), np.uint64)
    for bits in range(4):
        for _ in range(500):
            x = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            keys = np.flatnonzero((x & masks) == 0)
            assert simhash.chain_ok(np.repeat(x, len(keys)), keys // 2).any()


def components_of(nodes, edges):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            at[x] = x = at[at[x]]
        return x

    for a, b in edges:
        one, two = sorted((root(a), root(b)))
        at[two] = one
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain of 64", "chain of 1024", "chain of 10000", "sorted chain", "star", "clique", "several", "none"])
def test_components(spark, shape, monkeypatch):
    """Every shape gives the components of union by hand, long chains within 30 rounds."""
    rng, rounds = np.random.default_rng(3), []
    if shape.startswith("chain"):
        names = [int(x) for x in rng.permutation(int(shape.split()[-1]))]
        edges = list(zip(names, names[1:]))
    else:
        edges = {"sorted chain": [(i, i + 1) for i in range(300)], "star": [(5000, i) for i in range(3000)], "clique": [(i, j) for i in range(60) for j in range(60)], "none": []}.get(shape, [(int(a), int(b)) for a, b in rng.integers(-500, 500, (450, 2))])
    wanted = components_of({x for e in edges for x in e}, edges)
    plain = components.Scratch.written
    monkeypatch.setattr(components.Scratch, "written", lambda self, name, df: rounds.append(name) or plain(self, name, df))
    found = {r["node"]: r["root"] for r in collected(components.connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == wanted and len(rounds) < 32


def test_components_by_rounds_and_on_the_driver(spark, monkeypatch):
    """Both ways give the components of union by hand; edges with a null end are left out, self loops stay."""
    rng = np.random.default_rng(13)
    names = [int(x) for x in rng.permutation(400)]
    edges = [*zip(names, names[1:150]), *((-int(a), -int(b)) for a, b in rng.integers(1, 900, (400, 2))), (5000, 5000), *((7000 - i, 7000) for i in range(200)), (2**63 - 1, -(2**63))]
    wanted = components_of({x for e in edges for x in e}, edges)
    df = spark.createDataFrame([*edges, *edges[:50], (None, 3), (4, None), (None, None)], "a long, b long")
    for few in (1 << 18, 0):
        monkeypatch.setattr(components, "FEW", few)
        found = collected(components.connected_components(df))
        assert len(found) == len(wanted) and {r["node"]: r["root"] for r in found} == wanted


def test_near_copies_leave_few_files(spark):
    """Narrow tables between jobs have files by cores, not by partitions of a shuffle: on a local folder each file costs three processes."""
    from pathlib import Path

    from evigraph.llm.common import shared_dir

    rng = np.random.default_rng(17)
    texts = []
    for _ in range(120):
        base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        texts += [" ".join(base), " ".join([*base, "one"]), " ".join([*base, "two", "more"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    there = lambda: set(Path(shared_dir(spark).removeprefix("file:")).rglob("part-*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for step in (simhash.near_duplicates, nearcopies.near_copies):
            before = there()
            assert len(collected(step(df.repartition(2)))) == len(texts)
            assert 0 < len(there() - before) <= 4 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_near_copies_and_mixing_write_few_files(spark, monkeypatch):
    """Tables between jobs have files by cores, whatever the partitions of the input, and the members of groups none; nothing stays kept by the executors."""
    from pathlib import Path

    from evigraph.llm.common import shared_dir

    rng = np.random.default_rng(19)
    texts = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        texts += [" ".join(base), " ".join([*base, "one"]), " ".join([*base, "two", "more"])]
    df = spark.createDataFrame([(k, x, "ab"[k % 2]) for k, x in enumerate(texts)], "doc_id long, text string, source string").repartition(16)
    there = lambda: set(Path(shared_dir(spark).removeprefix("file:")).rglob("part-*"))
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size
    held, found = persisted(), []
    for large, tables in ((nearcopies.LARGE, 2), (2, 5)):
        monkeypatch.setattr(nearcopies, "LARGE", large)
        before = there()
        rows = collected(nearcopies.near_copies(df))
        assert 0 < len(there() - before) <= tables * spark.sparkContext.defaultParallelism and persisted() == held
        found.append({frozenset(r["doc_id"] for r in rows if r["root"] == root) for root in {r["root"] for r in rows}})
    assert found[0] == found[1] == {frozenset((k, k + 1, k + 2)) for k in range(0, len(texts), 3)}
    before = there()
    assert len(collected(mixing.draw(df))) == len(texts)
    assert 0 < len(there() - before) <= spark.sparkContext.defaultParallelism


def test_simhash_rows_come_in_few_partitions(spark, sf_dir):
    assert simhash.query(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_keep_one(spark, awkward, docs, empty):
    kept = collected(simhash.keep_one(awkward.filter("text is null or length(text) < 50000")))
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert 1 in ids and 6 not in ids and sum(r["text"] == "no id here" for r in kept) == 1
    assert sorted(r["text"] for r in kept if r["doc_id"] == 8) == ["same id", "same id, other text"]  # one id, but no copies
    classes = collected(simhash.near_duplicates(docs))
    assert {r["doc_id"] for r in collected(simhash.keep_one(docs))} == {r["component_id"] for r in classes}
    assert not collected(simhash.keep_one(empty))
    clash = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 8, 9, 10)], "doc_id long, text string, none int, number int, H int")
    for kept in (simhash.keep_one(clash), nearcopies.keep_one(clash)):
        assert [tuple(r) for r in kept.collect()] == [(1, "a b c d", 5, 6, 7)]


def test_large_groups_miss_no_link(spark, monkeypatch):
    """Groups dealt out in blocks give the components of all pairs."""
    rng = np.random.default_rng(11)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 200)], []
    for _ in range(120):
        copy = list(base)
        for at in rng.integers(0, 190, int(rng.integers(1, 7))):
            copy[at : at + 2] = [f"x{x}" for x in rng.integers(0, 10**6, 2)]
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    wanted = components_of(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for large in (4096, 8):
        monkeypatch.setattr(nearcopies, "LARGE", large)
        monkeypatch.setattr(nearcopies, "ANCHORS", 3)
        classes = defaultdict(list)
        for r in collected(nearcopies.near_copies(df)):
            classes[r["root"]].append(r["doc_id"])
        assert {frozenset(v) for v in classes.values()} == {frozenset(k for k in wanted if wanted[k] == r) for r in set(wanted.values())}
    assert 1 < len(set(wanted.values())) < 100


def test_ring_is_the_hamming_check():
    rng = np.random.default_rng(4)
    x = np.array([sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 30, 4000)], np.uint64)
    assert (simhash.ring_ok(x, nearcopies.SEGMENTS, nearcopies.RADIUS) == (np.bitwise_count(x) <= nearcopies.RADIUS)).all()


def test_stage_drops_copies_beyond_simhash(spark, awkward, empty):
    """Components of the pipeline's stage against all pairs, on families whose copies differ by replaced runs of words."""
    import corpus_pipeline

    rng = np.random.default_rng(7)
    texts = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(8):
            copy = list(base)
            for at in rng.integers(0, 290, int(rng.integers(0, 8))):
                copy[at : at + 3] = [f"x{x}" for x in rng.integers(0, 10**6, 3)]
            texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bits = [(simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() for a, b in near]
    assert max(bits) > simhash.LINK
    assert {r["doc_id"] for r in collected(corpus_pipeline.without_near_copies(spark, df, ""))} == set(group)
    kept = collected(nearcopies.keep_one(awkward))
    assert Counter(r["doc_id"] for r in kept) == Counter([1, 2, 5, None, 8, 8, 9, 10, 11, 12, 13, 14]) and not collected(nearcopies.keep_one(empty))


def test_repetition(awkward, empty, rows, docs):
    def brute(text):
        words = (text or "").encode().split()
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)

    for df, some in ((awkward, rows), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        found = collected(repetition.repetition_rules(df))
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == Counter((i, *brute(t)) for i, t in some)
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in found)
    assert not collected(repetition.repetition_rules(empty))


def test_longest_repeat_and_verdict(spark):
    words = [f"u{i}" for i in range(400)]
    clean, long = " ".join(words), " ".join(words[:200] + words[:130] + words[200:])
    spread = " ".join(" ".join(words[i : i + 12] * (2 if i % 36 == 0 else 1)) for i in range(0, 396, 12))
    found = {r["doc_id"]: r for r in collected(repetition.repetition_rules(spark.createDataFrame([(1, clean), (2, long), (3, spread)], "doc_id long, text string")))}
    assert found[1]["kept"] and found[1]["longest_repeat"] == 0
    assert not found[2]["kept"] and not found[2]["base_failed"] and found[2]["longest_repeat"] == 130
    assert not found[3]["kept"] and found[3]["longest_repeat"] == 12 and 0.3 < found[3]["repeat_share"] < 0.6


def test_repetition_verdict_against_brute_force(spark):
    """All suffixes compared by hand; the texts lie on both sides of each limit, and base passes some that the method rejects."""
    rng, limits = np.random.default_rng(9), repetition.Limits()
    texts = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(40, 160)))]
        for _ in range(k % 5):
            at, n = int(rng.integers(0, len(words))), int(rng.integers(2, 40))
            words[int(rng.integers(0, len(words))) : 0] = words[at : at + n]
        texts.append(" ".join(words))

    def brute(text):
        words = text.split()
        n = len(words)
        most = [max((next((k for k in range(n - max(i, j)) if words[i + k] != words[j + k]), n - max(i, j)) for j in range(n) if j != i), default=0) for i in range(n)]
        inside = {j for i in range(n) if most[i] >= limits.least for j in range(i, i + most[i])}
        share = sum(len(words[j]) for j in inside) / sum(map(len, words))
        starts = [i for i in range(n) if most[i] >= limits.least and (i == 0 or most[i - 1] != most[i] + 1)]
        longest = max(most)
        return round(share, 9), longest, len(starts), min((i for i in starts if most[i] == longest), default=-1), share <= limits.covered and longest <= limits.longest

    found = sorted(collected(repetition.repetition_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))), key=lambda r: r["doc_id"])
    for r, t in zip(found, texts, strict=True):
        share, longest, many, first, fine = brute(t)
        assert (round(r["repeat_share"], 9), r["longest_repeat"], r["n_repeats"], r["longest_start"]) == (share, longest, many, first)
        assert r["kept"] == (fine and not r["base_failed"])
    decided = [r for r in found if not r["base_failed"] and not r["kept"]]
    assert len(decided) >= 5 and sum(r["kept"] for r in found) >= 10


def test_mixing(awkward, empty, rows):
    found = collected(mixing.draw(awkward))
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    assert all(0 <= r["copies"] <= 2 for r in found)
    total = sum(r["size"] for r in found)
    targets = {r["source"]: r["target"] for r in found}
    assert sum(targets.values()) <= 1.5 * total + 1e-6
    assert [r for r in sorted(found, key=repr)] == sorted(collected(mixing.draw(awkward)), key=repr)
    assert not collected(mixing.draw(empty))
    assert mixing.mix(awkward).columns == awkward.columns
    assert not collected(mixing.mix(empty))


@pytest.mark.parametrize("sizes", [[10, 20, 30, 40], [1000, 1, 1, 1], [5], [0, 10, 0], [7, 7, 7, 7, 7, 7, 7], [1, 1000, 10_000, 3, 2]])
def test_targets_against_sharing_by_rounds(spark, sizes):
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
    found = {r["source"]: r["target"] for r in collected(mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")))}
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    cap, left, free, out = {n: 2.0 * s for n, s in zip(names, sizes, strict=True)}, 1.5 * sum(sizes), set(names), {}
    while free:
        over = {n for n in free if left * weights[n] / sum(weights[m] for m in free) > cap[n]}
        if not over:
            out |= {n: left * weights[n] / sum(weights[m] for m in free) for n in free}
            break
        out |= {n: cap[n] for n in over}
        left -= sum(cap[n] for n in over)
        free -= over
    assert found == pytest.approx(out)


def test_mix_follows_targets(docs):
    found = collected(mixing.draw(docs.filter("length(text) < 4000")))
    for source in {r["source"] for r in found}:
        own = [r for r in found if r["source"] == source]
        assert sum(r["copies"] * r["size"] for r in own) == pytest.approx(own[0]["target"], abs=1.5 * max(r["size"] for r in own))


def test_packing(awkward, empty, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.public_path())
    found = collected(packing.pack(awkward, packing.public_path()))
    wanted = Counter()
    for i, t in rows:
        wanted[i, tuple(model.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    for i, own in pieces.items():
        texts = [ids for (j, ids), n in wanted.items() for _ in range(n) if j == i]
        assert sum(r["length"] for r in own) == sum(map(len, texts))
        for r in own:
            assert any(len(ids) == r["doc_tokens"] and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for ids in texts)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= 2048 and len(own) <= 256 and total & (total - 1) == 0
    assert not collected(packing.pack(empty, packing.public_path()))


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(2)
    packer = packing.Packer(packing.Capacity(64, 5, 20), most=16)
    sizes = [int(x) for x in rng.integers(1, 200, 300)] + [1] * 100
    for k, n in enumerate(sizes):
        packer.add(packing.Example((k,), np.arange(n, dtype="<u4").tobytes(), 0, n, bytes(rng.integers(0, 2, n, dtype=np.uint8)) if k % 2 else None))
    packer.finish()
    covered, bins = Counter(), defaultdict(lambda: [0, 0])
    for row, start, n, _, total, sequence, offset in packer.out:
        covered[row] += n
        assert total == sizes[row] and offset == bins[sequence][0]
        bins[sequence][0] += n
        bins[sequence][1] += 1
    assert covered == Counter(dict(enumerate(sizes)))
    assert all(t <= 64 and s <= 5 for t, s in bins.values())


def test_instruction_data_bears_loss_after_the_prompt(spark):
    df = spark.createDataFrame([(1, "answer " * 30, "prompt " * 40), (2, "answer", None)], "doc_id long, text string, prompt string")
    found = collected(packing.pack(df, packing.public_path(), packing.Capacity(64, 4, 16), prompt_col="prompt"))
    assert sum(r["length"] for r in found) == 40 + 31 + 2


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.public_path())
    encoder, rng = packing.Encoder(packing.public_path(), most=50), np.random.default_rng(0)
    letters = list("aB'sré²½ÀßœİſŒ🙂é́ \t\n0123_-.,!tvemld<|>µªº÷×Ÿ中文ñ\x00\x7f")
    for _ in range(60):
        texts = ["".join(rng.choice(letters, int(rng.integers(0, 30)))) for _ in range(20)]
        texts += ["".join(rng.choice([*letters, "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|"], int(rng.integers(1, 9)))) for _ in range(10)] + ["a <|endoftext|> b", "x<|endoftext|>y", ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_against_plain_patterns(awkward, empty, rows):
    brute = brute_pii
    rng = np.random.default_rng(3)
    for k in range(5000):
        t = "".join(rng.choice(list("ab.@-_+0123 9" if k % 3 else "0123456789- +()."), int(rng.integers(0, 60))))
        assert list(pii.base_spans(t)) == brute(t)
    found = collected(pii.detect(awkward))
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in found) == Counter((i, *[Counter(x[0] for x in brute(t or ""))[k] for k in pii.KINDS[:4]]) for i, t in rows)
    assert not collected(pii.detect(empty))


def test_pii_method_adds_and_redacts(awkward):
    t = "IBAN DE89 3704 0044 0532 0130 00, wrong DE88 3704 0044 0532 0130 00; call 030 1234567 now and ask whoever is there whether it has been sent. Order 030 1234567; the card 4111 1111 1111 1111; x@y.zz"
    spans = pii.find(t)
    assert [x.kind for x in spans] == ["iban", "local", "card", "email"] and spans[2].score == 0.85
    assert pii.redact(t, spans).startswith("IBAN <IBAN>, wrong DE88 3704 0044 0532 0130 00; call <LOCAL> now")
    out = {r["doc_id"]: r for r in collected(pii.redacted(awkward))}
    assert out[11]["text"] == "mail <EMAIL>, <PHONE> and <IP>" and out[2]["text"] is None and out[5]["copies"] == 9


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"), ("GB82 WEST 1234 5698 7654 32 A transfer", "GB82 WEST 1234 5698 7654 32"), ("DE89370400440532013000 2024 invoice", "DE89370400440532013000"),
        ("AB12 CDEF DE89 3704 0044 0532 0130 00 EUR", "DE89 3704 0044 0532 0130 00"), ("DE89370400440532013000", "DE89370400440532013000"), ("DE89370400440532013000x", None), ("DE88370400440532013000 BIC", None),
    ],
)
def test_ibans_before_upper_case_words(text, number):
    assert [text[x.start : x.end] for x in pii.find(text) if x.kind == "iban"] == [number] * (number is not None)
    assert number is None or pii.redact(text, [x for x in pii.find(text) if x.kind == "iban"]) == text.replace(number, "<IBAN>")


def test_pii_finds_planted_secrets_and_leaves_clean_texts(docs):
    rng = np.random.default_rng(6)
    hexed = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    mixed = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    plant = [lambda: f'token = "{hexed(40)}"', lambda: f"api_key: {mixed(32)}", lambda: f"password='{mixed(9)}'", lambda: f"AKIA{hexed(16).upper()}", lambda: f"Authorization: Bearer {mixed(48)}", lambda: "SSN 123-45-6789", lambda: "IBAN GB82 WEST 1234 5698 7654 32"]
    clean = [r["text"] for r in docs.filter("text is not null").collect() if not pii.find(r["text"])]
    hit = 0
    for k in range(210):
        words = clean[k % len(clean)].split()
        at, secret = int(rng.integers(0, len(words) + 1)), plant[k % len(plant)]()
        text = " ".join([*words[:at], secret, *words[at:]])
        start = text.index(secret)
        hit += any(start <= x.start and x.end <= start + len(secret) for x in pii.find(text))
    assert hit >= 0.95 * 210
    for t in ("the sha1 checksum da39a3ee5e6b4b0d3255bfef95601890afd80709", "a-very-long-hyphenated-compound-word-indeed", "part 123-45-6789", "https://example.com/some/long/path/to/a/page", "pneumonoultramicroscopicsilicovolcanoconiosis", "12345678901234567890123"):
        assert not [x for x in pii.find(t) if x.kind in pii.KINDS[pii.BASE :]], t


def test_pii_digests_against_brute_force(awkward, rows, docs):
    import hashlib

    order = {k: i for i, k in enumerate(pii.KINDS)}
    for df, some in ((awkward, rows), (docs, [(r["doc_id"], r["text"]) for r in docs.collect()])):
        found = collected(pii.detect(df))
        wanted = Counter()
        for i, t in some:
            base = sorted(brute_pii(t or ""), key=lambda x: (x[1], order[x[0]]))
            wanted[i, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["base_sha256"]) for r in found) == wanted
        for r in found:
            spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
            assert spans == sorted(spans, key=lambda x: (x[1], order[x[0]])) and len(spans) == r["n_spans"]
            assert hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in pii.KINDS[:4]).encode()).hexdigest() == r["base_sha256"]


def test_pii_added_spans_cut_none(awkward):
    """Against comparing each stretch with all that are taken; and time grows with the text, not its square."""
    import time

    rng = np.random.default_rng(8)
    for _ in range(300):
        base = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 100, 6), rng.integers(1, 20, 6), strict=True)]
        taken, plain = pii.Taken(base), list(base)
        for s, n in zip(rng.integers(0, 100, 10), rng.integers(1, 20, 10), strict=True):
            free = not any(a < s + n and s < b for a, b in plain)
            assert taken.add(int(s), int(s + n), False) == free
            plain += [(s, s + n)] * free
    took = []
    for n in (2000, 16_000):
        began = time.perf_counter()
        assert len(pii.find("call 030 1234567 now, " * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_quality(spark, awkward, empty, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    found = collected(quality.score(docs, model))
    truth = {r["doc_id"]: r["quality"] for r in collected(labels)}
    own = [r for r in found if r["doc_id"] in truth]
    assert sum((r["predicted"] == truth[r["doc_id"]]) for r in own) / len(own) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len(collected(quality.score(awkward, model))) == awkward.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in collected(quality.score(awkward, model)))
    assert not collected(quality.score(empty, model))
    kept = collected(quality.accepted(awkward, model))
    assert len(kept) == sum(r["predicted"] for r in collected(quality.score(awkward, model)))
    none = quality.train(docs, labels.filter("quality is null"))
    assert {r["score"] for r in collected(quality.score(docs, none))} == {0.5}
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int")
    assert len(collected(quality.score(docs, quality.train(docs, odd)))) == docs.count()


def test_quality_tables_are_additive():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_language_id(spark, awkward, empty, docs):
    model = langid.train(docs, langid.public_path(), texts=60)
    found = collected(langid.identify(docs, model))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    odd = collected(langid.identify(awkward, model))
    assert len(odd) == awkward.count()
    for r, t in ((r, t) for r in odd for i, t in [(x["doc_id"], x["text"]) for x in awkward.collect()] if i == r["doc_id"] and i in (2, 3, 4)):
        assert r["lang_pred"] == "und" and r["score"] == 0, t
    assert langid.train(empty, langid.public_path()) is None
    assert langid.words_of("A½b ½ ² Ⅷ_x1y") == ["ab", "x", "y"]
    assert {r["lang_pred"] for r in collected(langid.identify(docs, None))} == {"und"}
    assert not collected(langid.identify(empty, model))


def test_forward_sums_all_segmentations():
    vocabulary = langid.pieces(langid.public_path())
    at = {x: k for k, x in enumerate(vocabulary)}
    p = langid.normal(np.random.default_rng(0).random((len(vocabulary) + 1, 2)))
    lattice = langid.Lattice(vocabulary)

    def brute(s):
        if not s:
            return np.ones(2)
        total = sum((p[at[s[:j]]] * brute(s[j:]) for j in range(1, len(s) + 1) if s[:j] in at), np.zeros(2))
        return total if s[0] in at else total + p[-1] * brute(s[1:])

    words = ["the", "house", "çaß", "qжx", "internat"]
    assert np.exp(langid.logs(words, lattice, p)) == pytest.approx(np.array([brute("▁" + w) for w in words]))
    assert langid.scaled("house" * 9, lattice, p) == pytest.approx(langid.logs(["house" * 9], lattice, p)[0])
    counts = langid.expected(["house"], np.ones(1), np.zeros(1, int), lattice, p)
    assert sum(counts[k, 0] * len(x) for k, x in enumerate(vocabulary)) == pytest.approx(6) and counts[:, 1].sum() == 0


def test_hmm_recursions_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    sequences = [np.array(rng.integers(0, 5, n), np.int32) for n in (1, 4, 2, 6, 6, 3)]
    start, move, emit, likelihood = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for x in sequences:
        paths = {z: m.start[z[0]] * m.emit[x[0], z[0]] * math.prod(m.move[z[i - 1], z[i]] * m.emit[x[i], z[i]] for i in range(1, len(x))) for z in product(range(3), repeat=len(x))}
        total = sum(paths.values())
        likelihood.append(math.log10(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for i in range(len(x)):
                emit[x[i], z[i]] += p / total
                if i:
                    move[z[i - 1], z[i]] += p / total
    batch = hmm.Batch(sequences)
    assert batch.forward(m)[0] == pytest.approx(likelihood)
    for a, b in zip(batch.expect(m), (start, move, emit), strict=True):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("head", [20, 100_000])
def test_hmm_base_score(awkward, empty, docs, head):
    for df in (docs, awkward):
        found = collected(hmm.score(df, symbols=15, head=head, rounds=1))
        texts = [(r["doc_id"], [*(r["text"] or "").encode().lower().split(), hmm.END]) for r in df.collect()]
        counts = Counter()
        for i, t in texts:
            if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
                counts.update(t)
        n, v = sum(counts.values()), len(counts)
        wanted = sorted((str(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in texts)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
        assert all(r["score"] < 0 for r in found)
    assert not collected(hmm.score(empty))


def test_hmm_training_covers_all_texts(docs, empty):
    """Stepwise rounds and whole rounds against the same in numpy; a part without texts changes nothing."""
    from pyspark.sql import functions as F

    parts, states = 5, 3
    rows = [(r["p"], hmm.tokens((r["text"] or "").encode())) for r in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("p"), "text").filter("p <> 3").collect()]
    counts = Counter(w for _, t in rows for w in [*t, hmm.END])
    head = sorted((w for w in counts if w != hmm.END), key=lambda w: (-counts[w], w))[:50]
    words = hmm.Words(sum(counts.values()), len(counts), counts[hmm.END], head, [counts[w] for w in head], 50)
    number = {w: k for k, w in enumerate(head)}
    coded = [(p, np.array([*[number.get(w, 50) for w in t], 51])) for p, t in rows]
    unigram = words.unigram()

    def expected(some, m):
        return np.concatenate([x.reshape(-1, states) for x in hmm.Batch(some).expect(m)])

    def renewed(m, n):
        return hmm.improved(m, n[0], n[1 : 1 + states], n[1 + states :], unigram)

    m, held = hmm.first_model(unigram, states), None
    for k in (0, 1, 2, 4):
        new = expected([x for p, x in coded if p == k], m)
        weight = (k + 2) ** -hmm.DECAY
        held = new if held is None else (1 - weight) * held + weight * new
        m = renewed(m, held)
    m = renewed(m, expected([x for _, x in coded], m))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    found = hmm.train(docs.filter(part != 3).select("doc_id", "text"), words, states, 1, parts)
    for a, b in zip((found.start, found.move, found.emit), (m.start, m.move, m.emit), strict=True):
        assert a == pytest.approx(b)
    nothing = hmm.train(empty.select("doc_id", "text"), hmm.Words(0, 0, 0, [], []), states)
    assert nothing.start.sum() == pytest.approx(1) and nothing.emit.sum(0) == pytest.approx(np.ones(states))


def test_hmm_groups_change_nothing(docs, monkeypatch):
    one = {r["doc_id"]: r["score"] for r in collected(hmm.score(docs, rounds=1))}
    plain = hmm.grouped
    monkeypatch.setattr(hmm, "grouped", lambda s, most=2000: plain(s, most))
    assert {r["doc_id"]: r["score"] for r in collected(hmm.score(docs, rounds=1))} == pytest.approx(one)


def test_sketches(spark, awkward, empty, docs):
    for df in (docs, awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        import hashlib

        found = sorted(collected(sketches.compare_neighbours(df)), key=lambda r: r["doc_id"])
        texts = [r["text"] or "" for r in df.orderBy("doc_id").collect()]
        assert len(found) == len(texts)
        for k, (r, t) in enumerate(zip(found, texts, strict=True)):
            after, n = texts[(k + 1) % len(texts)], len(t) // 4
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same = defaultdict(set)
        for r, t in zip(found, texts, strict=True):
            same[t].add(r["fingerprint"])
        assert all(len(v) == 1 for v in same.values())
    long = [r for r in collected(sketches.compare_neighbours(docs)) if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.7 and np.mean([r["near_next"] for r in long]) < 0.05
    assert len(collected(sketches.compare_neighbours(awkward))) == awkward.count()
    assert not collected(sketches.compare_neighbours(empty))
    lone = collected(sketches.compare_neighbours(docs.limit(1)))[0]
    assert lone["near_next"] == 1.0


def test_sketches_against_brute_force(spark, docs):
    import struct

    def of(words, n):
        runs = [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words] if words else []
        out = set()
        for run in runs:
            seed = 42
            for w in run:
                seed = xxhash.xxh64_intdigest(struct.pack("<Q", xxhash.xxh64_intdigest(w.encode(), 42)), seed)
            out.add(seed)
        return out

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {h for h in of(words, 5) if (h ^ (1 << 63)) < (1 << 64) // sketches.SCALE}, of(words, sketches.FINE) if len(words) < sketches.FEW else set()

    def within(a, b):
        if not any(a) and not any(b):
            return 1.0
        x, y = (a[1], b[1]) if a[1] and b[1] else (a[0], b[0])
        return len(x & y) / len(x) if x and y else 0.0

    def shown(a):
        signed = lambda s: "".join(f"{h:016x}" for h in sorted(s, key=lambda h: h ^ (1 << 63)))
        return signed(a[0]) + ("." + signed(a[1]) if a[1] else "")

    rng = np.random.default_rng(12)
    short = [" ".join(rng.choice([f"v{x}" for x in range(400)], int(n))) for n in rng.integers(0, 60, 200)]
    for df in (docs.filter("doc_id < 60"), spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")):
        texts = [r["text"] or "" for r in df.orderBy("doc_id").collect()]
        found = sorted(collected(sketches.compare_neighbours(df)), key=lambda r: r["doc_id"])
        for k, (r, t) in enumerate(zip(found, texts, strict=True)):
            after, n = texts[(k + 1) % len(texts)], len(t) // 4
            own, edited, following = brute(t), brute(t[: len(t) - n] + after[:n]), brute(after)
            assert r["fingerprint"] == shown(own) and r["edited_fingerprint"] == shown(edited)
            assert r["near_edited"] == pytest.approx(max(within(own, edited), within(edited, own))) and r["near_next"] == pytest.approx(max(within(own, following), within(following, own)))
    few = [(r["near_edited"], r["near_next"]) for r, t in zip(found, texts, strict=True) if len(t.split()) >= 6]
    assert sum(a > b for a, b in few) >= 0.98 * len(few)


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(300, 340)))], "a string, b string")
    r = df.select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    r = r.select(sketches.containment(F.col("b"), F.col("a")).alias("inside"), sketches.containment(F.col("a"), F.col("b")).alias("around"), sketches.merge(F.col("a"), F.col("b")).alias("m"), "a").first()
    assert r["inside"] == 1.0 and r["around"] < 0.3 and r["m"] == r["a"]
