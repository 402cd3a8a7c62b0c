import random
import zlib

import numpy as np
import pytest

from quillspark.llm.packing import best_fit, pack, plan, reduce_by_dominance, slot_arrays
from quillspark.llm.tokens import BatchEncoder

from .conftest import RANKS, TOKENIZER


def fewest(items, capacity):
    best, items = len(items), sorted(items, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("capacity", [7, 12, 20])
def test_dominance_keeps_an_optimum(capacity):
    rng = random.Random(capacity)
    for _ in range(150):
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        rest = counts.copy()
        fixed = reduce_by_dominance(rest, capacity)
        left = [x for x in range(capacity + 1) for _ in range(rest[x])]
        assert sum(n for _, n in fixed) + (fewest(left, capacity) if left else 0) == fewest(items, capacity)


def test_plan_uses_every_item_once():
    counts = np.zeros(1025, np.int64)
    counts[1:] = np.random.default_rng(0).zipf(1.4, 1024) % 5000
    used = np.zeros(1025, np.int64)
    patterns = plan(counts)
    for pattern, n in patterns:
        assert sum(x * k for x, k in pattern) <= 1024 and n > 0
        for x, k in pattern:
            used[x] += n * k
    assert (used == counts).all() and len(patterns) < 4 * 1024
    plain = sum(n for _, n in best_fit(counts, 1024))
    assert sum(n for _, n in patterns) <= plain + 1
    assert len(slot_arrays(patterns)["key"]) == sum(len(p) for p, _ in patterns)


def test_ids_are_the_tokenizers(vocab):
    enc = BatchEncoder(vocab[TOKENIZER], vocab[RANKS])
    rng = random.Random(1)
    letters = ["a", "b", "é", " ", "  ", "\n", "\t", "1", "22", "!", "'", "'s", "don't", "ß", "中", "$$", "<|endoftext|>", "\r\n", "_", "😀", "word", "\xa0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    flat, at = enc.encode(texts)
    want = enc.whole.encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert flat[at[i]:at[i + 1]].tolist() == w.ids, texts[i]


def test_pack(spark, vocab, odd_docs, empty_docs):
    tokenizer, ranks = vocab[TOKENIZER], vocab[RANKS]
    assert pack(empty_docs, tokenizer, ranks).count() == 0
    rows = pack(odd_docs, tokenizer, ranks, capacity=64, keep_ids=True).collect()
    enc = BatchEncoder(tokenizer)
    want = sorted(enc.whole.encode(r.text or "", add_special_tokens=False).ids + [2] for r in odd_docs.collect())
    bins = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 64
    total = sum(map(len, want))
    assert sum(r.length for r in rows) == total and len(bins) >= -(-total // 64)
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [r.start for r in long] == [sum(x.length for x in long[:i]) for i in range(len(long))]
    assert all(r.length == 64 for r in long[1:])
    joined = [i for r in long for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert joined in want
