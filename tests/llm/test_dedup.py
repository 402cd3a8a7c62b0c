import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import exact_dedup as exact
from quillspark.llm import near_dedup as near
from quillspark.llm.components import connected_components
from quillspark.llm.suffix_dedup import remove_repeats
from quillspark.llm.suffix_sort import adjacent_lcp, suffix_order

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact(spark, odd_docs, empty_docs):
    assert exact.exact_dedup(empty_docs).count() == 0
    got = exact.exact_dedup(odd_docs).collect()
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[(r.text or "").translate(LOW)].append(r.doc_id)
    assert len(got) == odd_docs.count()
    for r in got:
        text = (r.text or "").translate(LOW)
        keep = max((i for i in groups[text] if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(groups[text]), r.doc_id == keep)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.lang != "lost"


def test_filters_never_miss(spark):
    values = [i * 7919 for i in range(5000)] + [i * 7919 for i in range(0, 5000, 50)]
    df = spark.createDataFrame([(v,) for v in values], "h long").repartition(5)
    packed, segments = exact.value_filter(df, len(values))
    maybe = exact.may_hold(spark.sparkContext.broadcast(packed), segments)
    found = {r.h for r in df.where(maybe("h")).collect()}
    assert found >= {i * 7919 for i in range(0, 5000, 50)} and len(found) < 1000


def test_full_filter_keeps_results(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_FILTER_BITS", 1 << 13)
    monkeypatch.setattr(exact, "SEGMENT_BITS", (64, 64))
    df = spark.createDataFrame([(i, f"t{i % 700}") for i in range(2000)], "doc_id long, text string")
    got = exact.exact_dedup(df).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(1300, 2000))


def brute_near(rows, words, share):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k:k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(seed, n):
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 60 if k % 3 == 0 else 900)}" for _ in range(rng.randint(5, 60))] for k in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.9 else [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 30)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("small, outside, together", [(256, 1024, 4096), (8, 4, 10), (8, 40, 4096)])
def test_near(spark, monkeypatch, small, outside, together):
    monkeypatch.setattr(near, "TOGETHER", together)
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "OUTSIDE", outside)
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = near_rows(small + outside, 220)
    want = brute_near(rows, 2, (4, 5))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df, words=2).collect()}
    assert got == want


def test_near_odd_rows(spark, odd_docs, empty_docs):
    assert near.near_duplicates(empty_docs).count() == 0
    got = near.near_duplicates(odd_docs, words=2).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles > 0, r.component_id, r.kept))
    assert by[1] == {(True, 1, True)} and by[2] == {(True, 1, False)} and by[8] == {(True, 1, False)}
    assert by[3] == {(False, 3, True)} and by[4] == {(False, 4, True)} and by[7] == {(False, 7, True)}
    assert by[None] == {(True, None, True), (False, None, True)}


def test_near_repeated_ids(spark):
    """Rows that share an id are linked by their own texts, whichever of them comes first."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a + " tail"), (5, a), (5, b), (9, b + " tail"), (5, b), (1, "else")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(df, words=2).collect())
    assert got == [(1, 1, 1, True), (3, 40, 3, True), (5, 39, 3, False), (5, 39, 5, True), (5, 39, 5, True), (9, 40, 5, False)]


def test_vertices_shuffle_tokens_once(spark):
    """One exchange holds the tokens, and after the map side a group of copies is one row a task."""
    rows = spark.range(0, 90, 1, 3).select("id", (F.col("id") % 2).alias("k1"), (F.col("id") % 2 + 7).alias("k2"), (F.col("id") % 2 + 5).alias("n"), F.col("id").cast("string").cast("binary").alias("tokens"))
    out = near._vertices(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_first(tokens" in plan
    assert sorted((r.doc, r.k1, r.n) for r in out.collect()) == [(0, 0, 5), (1, 1, 6)]


@pytest.mark.parametrize("between", [False, True])
def test_promising_names_who_needs_a_sketch(monkeypatch, between):
    """Codes are a fifth of a sketch; they pass all linked pairs and hardly any others."""
    monkeypatch.setattr(near, "PAIRS", 50)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, (6, 400), dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 6][: 400 - 12 * (i // 6)], rng.integers(0, 2**63, 2 * (i // 6), dtype=np.uint64)])) for i in range(18)]
    sets += [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(12)]
    tokens = np.array([near.minwise_tokens(s) for s in sets])
    bits = near._code.func(pa.array([row.astype(np.uint8).tobytes() for row in tokens], pa.binary())).to_pylist()
    assert {len(b) for b in bits} == {near.CODE // 2}
    rows = [{"id": i, "cluster": i % 6 if i in (0, 6) else 100 + i, "n": len(s), "bits": b} for i, (s, b) in enumerate(zip(sets, bits))]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("cluster", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())]))
    lists = [rows[:20], rows[20:21], rows[10:]]
    others = [rows[12:15], rows[:2], rows[:6]] if between else [None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(lists, kind), pa.array(others, kind)], ["path", "members", "others"])
    want = set()
    for path, some, rest in zip((7, 8, 9), lists, others):
        for x in some:
            for y in some if rest is None else rest:
                if x["id"] % 6 == y["id"] % 6 and max(x["id"], y["id"]) < 18 and x["cluster"] != y["cluster"]:
                    want |= {(path, r["id"], r["cluster"]) for r in (x, y)}
    got = [tuple(r.values()) for out in near._promising(0.8)(iter([batch])) for r in out.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want and (9, 25, 125) not in want


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_suffix_order():
    rng = random.Random(6)
    for depth in (5, 40, 90):
        texts = []
        for _ in range(400):
            t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, depth)))
            texts.append(t if rng.random() < 0.5 or not texts else (rng.choice(texts) + t)[:depth])
        rows = np.zeros((len(texts), depth), np.uint8)
        for i, t in enumerate(texts):
            rows[i, : len(t)] = np.frombuffer(t, np.uint8) + 1
        group = np.array([rng.randint(0, 2) for _ in texts])
        order = suffix_order(rows, group)
        want = sorted((g, t) for g, t in zip(group.tolist(), texts))
        assert [(int(group[i]), texts[i]) for i in order] == want
        length = np.array([len(t) for t in texts])
        lcp = adjacent_lcp(rows, order, length, group)
        for k in range(1, len(want)):
            a, b = want[k - 1], want[k]
            same = next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))
            assert lcp[k] == (same if a[0] == b[0] else -1)


def brute_repeats(texts, least):
    seen = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i:i + least]] > 1:
                covered[i:i + least] = b"\1" * least
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = sum(1 for i in range(len(t)) if covered[i] and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("least, large", [(12, 4_096), (12, 1), (5, 3), (40, 2)])
def test_repeats(spark, least, large):
    rng = random.Random(least + large)
    texts = []
    for _ in range(120):
        t = "".join(rng.choice("abé") for _ in range(rng.choice([0, 3, 12, 13, 20, 60, 200])))
        if texts and rng.random() < 0.6:
            other = rng.choice(texts)
            at = rng.randint(0, len(other))
            t = t[:30] + other[at:at + rng.randint(5, 60)] + t[30:60]
        texts.append("a" * rng.randint(10, 60) if rng.random() < 0.1 else t)
    df = spark.createDataFrame([(i, t or None, 1) for i, t in enumerate(texts)], "doc_id long, text string, cut int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, least=least, large=large).select("doc_id", "cut.*").collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], least)))


def test_repeats_odd_rows(spark, odd_docs, empty_docs):
    assert remove_repeats(empty_docs).count() == 0
    rows = remove_repeats(odd_docs).select("doc_id", "text", "cut.*").collect()
    want = brute_repeats([(r.text or "").encode() for r in rows], 200)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want
