"""Quality classifier: random-indexing word vectors, a two-layer network, temperature.

Every word gives two units: the word itself and its *form* (capital, small,
digit and other characters with runs merged, and whether it repeats the word
before it), so words that the fit has not seen still say something. Random
indexing gives each unit a sparse ternary index vector, drawn from its hash, and
a unit's vector is the sum of the index vectors around it and its own. A
document pools the vectors of its words and of its forms. Two dense layers turn
that into a logit; the temperature that best calibrates it on a part of the fit
sample, kept from the training, divides it.

The fit runs on the driver over a bounded sample: at most ``SAMPLE`` labelled
rows, chosen by a hash of their id, of at most ``SAMPLE_CHARS`` characters each.
Scoring runs over all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import session

SAMPLE = 5000
SAMPLE_CHARS = 20_000
WORDS, FORMS, DIMS, NONZERO, HIDDEN = 20_000, 2_000, 64, 6, 32
EPOCHS, RATE, DECAY, SEED = 60, 0.01, 1e-4, 7
#: 'A', 'a', '0' for capital, small (all beyond ASCII too) and digit; others stand for themselves.
_FORM = np.arange(256, dtype=np.uint8)
_FORM[65:91], _FORM[97:123], _FORM[128:], _FORM[48:58] = 65, 97, 97, 48


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, form hashes, and the first word of each text."""
    data, offsets = textvec.string_bytes(texts)
    start, end, first = textvec.words(data, offsets)
    word = textvec.range_hash(textvec.prefix_hash(data), start, end)
    kind = _FORM[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    place = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    form = textvec.range_hash(textvec.prefix_hash(kind[keep]), place[start], place[end])
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    same[first[:-1][first[:-1] < len(word)]] = False
    return word, form ^ (same.astype(np.uint64) * np.uint64(0x6A09E667F3BCC909)), first


def _index_vectors(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes), DIMS), np.float32)
    h = hashes.copy()
    for _ in range(NONZERO):
        h = textvec.mixed(h + np.uint64(0x9E3779B97F4A7C15))
        out[np.arange(len(h)), (h % np.uint64(DIMS)).astype(np.int64)] += np.where(h >> np.uint64(63), 1, -1)
    return out


@dataclass
class Lexicon:
    """Known units (sorted hashes) and their vectors; the last row stands for all others."""

    hashes: np.ndarray
    vectors: np.ndarray

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))


def _most_frequent(parts: list[np.ndarray], n: int) -> np.ndarray:
    h, count = np.unique(np.concatenate(parts), return_counts=True)
    return np.sort(h[np.argsort(-count, kind="stable")[:n]])


@dataclass
class Model:
    words: Lexicon
    forms: Lexicon
    scale: tuple[np.ndarray, np.ndarray]
    layers: list[np.ndarray]
    temperature: float

    def pooled(self, texts: pa.Array) -> np.ndarray:
        word, form, first = units(texts)
        n = np.maximum(np.diff(first), 1)[:, None]
        return np.concatenate([_sums(lex, h, first) / n for lex, h in ((self.words, word), (self.forms, form))], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.scale[0]) / self.scale[1] @ w1 + b1) @ w2 + b2[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -30, 30)))


def _sums(lexicon: Lexicon, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the units' vectors of each text, counting equal units once."""
    out = np.zeros((len(first) - 1, lexicon.vectors.shape[1]))
    ids = lexicon.ids(h)
    width = len(lexicon.vectors)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair, times = np.unique(owner * width + ids, return_counts=True)
    for at in range(0, len(pair), 1 << 16):
        p = pair[at:at + (1 << 16)]
        row = p // width
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        v = lexicon.vectors[p % width] * times[at:at + (1 << 16), None].astype(np.float32)
        out[row[start]] += np.add.reduceat(v, start, axis=0)
    return out


def _random_indexing(parts, words: np.ndarray, forms: np.ndarray) -> tuple[Lexicon, Lexicon]:
    out = []
    index = {"w": np.vstack([_index_vectors(words), np.zeros((1, DIMS), np.float32)]), "f": np.vstack([_index_vectors(forms), np.zeros((1, DIMS), np.float32)])}
    lex = {"w": Lexicon(words, index["w"]), "f": Lexicon(forms, index["f"])}
    total = {k: np.zeros_like(v) for k, v in index.items()}
    for word, form, first in parts:
        ids = {"w": lex["w"].ids(word), "f": lex["f"].ids(form)}
        context = index["w"][ids["w"]] + index["f"][ids["f"]]
        around = np.zeros_like(context)
        around[1:] += context[:-1]
        around[:-1] += context[1:]
        inner = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(word))]
        around[inner] -= context[inner - 1]  # contexts end with the text
        around[inner - 1] -= context[inner]
        for k in ids:
            order = np.argsort(ids[k], kind="stable")
            if not len(order):
                continue
            sorted_ids = ids[k][order]
            start = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            total[k][sorted_ids[start]] += np.add.reduceat(around[order], start, axis=0)
    for k, hashes in (("w", words), ("f", forms)):
        v = total[k] / np.maximum(np.linalg.norm(total[k], axis=1, keepdims=True), 1e-9) + index[k] / np.sqrt(NONZERO)
        out.append(Lexicon(hashes, v.astype(np.float32)))
    return out[0], out[1]


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two dense layers by Adam on the mean logistic loss, both labels weighing the same."""
    rng = np.random.default_rng(SEED)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            i = order[at:at + 128]
            hidden = np.tanh(x[i] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3][0], -30, 30)))
            d = weight[i] * (p - y[i]) / len(i)
            back = np.outer(d, layers[2]) * (1 - hidden**2)
            grads = [x[i].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ d + DECAY * layers[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    grid = np.geomspace(0.25, 8, 41)
    sign = np.where(y == 1, -1, 1)
    return float(min(grid, key=lambda t: np.logaddexp(0, sign * logits / t).mean()))


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """None where the labels don't hold both values."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    parts = []
    for at in range(0, len(texts), 200):
        parts.append(units(pa.array(texts[at:at + 200], pa.string())))
    words = _most_frequent([p[0] for p in parts], WORDS)
    forms = _most_frequent([p[1] for p in parts], FORMS)
    if not len(words):
        return None
    model = Model(*_random_indexing(parts, words, forms), (np.zeros(1), np.ones(1)), [], 1.0)
    del parts
    x = np.vstack([model.pooled(pa.array(texts[at:at + 200], pa.string())) for at in range(0, len(texts), 200)])
    model.scale = (x.mean(0), x.std(0) + 1e-6)
    held = np.random.default_rng(SEED).random(len(y)) < 0.2
    if held.all() or y[~held].min() == y[~held].max():
        held[:] = False
    model.layers = _train((x[~held] - model.scale[0]) / model.scale[1], y[~held])
    check = held if held.any() else ~held
    model.temperature = _temperature(model.logits(x[check]), y[check])
    return model


def held_out(doc_id: str | Column) -> Column:
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model | None:
    """Fits on labelled rows outside the held-out fold (see the bounds above).

    Null texts, null or unknown labels and null ids aren't learned from; an id that
    several rows share counts once for each label it has, with the smallest of its
    texts; other columns don't matter. None where what is left is empty or has one
    label only.
    """
    some = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    some = some.where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & ~held_out("__id"))
    some = some.orderBy(F.xxhash64("__id"), "__y").limit(SAMPLE)
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("__t")).where(F.length("__t") <= SAMPLE_CHARS)
    # at most SAMPLE labels are broadcast, and as many rows come back: of rows that share an id one text
    rows = texts.join(F.broadcast(some), F.col("__doc") == F.col("__id")).groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    rows = sorted(rows.collect(), key=lambda r: (r["__id"], r["__y"], r["__t"]))
    return fit([r["__t"] for r in rows], [r["__y"] for r in rows])


def score(docs: DataFrame, model: Model | None, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of label 1 for each whole text.

    A null text counts as an empty one, whose pooled vector is zero; without a
    model (no labels, or all the same) every score is 1. Other columns pass through,
    one called ``name`` is replaced, and an empty table gives an empty result.
    """
    spark = session(docs)
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scores(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        parts = [shared.value.scores(part.column(0)) for part in textvec.chunks(batch, "t")]
        textvec.release()
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return docs.withColumn(name, scores.asNondeterministic()(F.col(text)))  # a filter on it doesn't evaluate it again
