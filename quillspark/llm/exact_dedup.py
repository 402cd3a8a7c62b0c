"""Exact deduplication by two-pass Bloom filtering.

Pass 1 reduces the corpus to 64-bit hashes. Hashes are dealt by their high bits
to *segments*; the task of a segment streams what every input task has seen
through a "seen" Bloom filter and marks in a "repeated" Bloom filter each hash
that was there already. Pass 2 tests every row against the repeated filter: a
row whose hash can't be repeated passes straight through, and only the rest
shuffle, carrying a digest instead of their text, to be grouped exactly. False
positives of either filter cost a little shuffle and never change a result.

The repeated filter is the only thing broadcast. Its size is a power of two
chosen from the row count and never over ``MAX_FILTER_BITS``; on larger inputs
it gets fuller and more rows take the shuffled path, with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, session, shuffle_partitions
from .textvec import chunks, releasing, string_bytes

#: 32 MiB: the most that pass 2 broadcasts.
MAX_FILTER_BITS = 1 << 28
SEGMENT_HASHES = 1 << 16
SEGMENT_BITS = (1 << 20, 1 << 25)
PROBES = 4


def _power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash (double hashing), one row per probe."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a[None, :] + k * b[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def _remixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (segments - 1)


def _longs(batch: pa.RecordBatch):
    yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _digest_heads(batch: pa.RecordBatch):
    for part in chunks(batch, "text"):
        yield np.frombuffer(b"".join(d[:8] for d in lowered_digests(part.column(0))), np.uint64)


def _local_pass(segments: int, least: int, read):
    """Of one task: for each segment its distinct hashes, and which of them came ``least`` times."""

    def run(batches):
        parts, held = [], 0

        def flush():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            seg = _segment_of(h, segments)
            order = np.argsort(seg, kind="stable")
            h, n, seg = h[order], n[order], seg[order]
            ids, at = np.unique(seg, return_index=True)
            ends = [*at[1:], len(h)]
            return pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(ids, pa.int64()),
                    "hashes": pa.array([h[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
                    "twice": pa.array([(n[a:b] >= least).tobytes() for a, b in zip(at, ends)], pa.binary()),
                }
            )

        for batch in batches:
            for h in read(batch):
                parts.append(h)
                held += len(h)
                if held >= 1 << 20:
                    yield flush()
                    parts, held = [], 0
        if held:
            yield flush()

    return run


def _merge_pass(segments: int, filter_bits: int, seen_bits: int):
    """Streams a task's segments, one "seen" filter at a time; emits filter chunks."""
    chunk_bits = filter_bits // segments

    def run(batches):
        current, seen, marked = None, None, None

        def done():
            return pa.RecordBatch.from_pydict(
                {"segment": pa.array([current], pa.int64()), "bits": pa.array([np.packbits(marked).tobytes()], pa.binary())}
            )

        for batch in batches:
            for seg, hashes, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if seg != current:
                    if current is not None and marked.any():
                        yield done()
                    current, seen, marked = seg, np.zeros(seen_bits, bool), np.zeros(chunk_bits, bool)
                h = np.frombuffer(hashes, np.uint64)
                at = _positions(h, seen_bits)
                again = seen[at].all(axis=0) | np.frombuffer(twice, bool)
                seen[at] = True
                marked[_positions(_remixed(h[again]), chunk_bits)] = True
        if current is not None and marked.any():
            yield done()

    return run


def value_filter(hashes: DataFrame, rows: int, least: int = 2, read=_longs) -> tuple[np.ndarray, int]:
    """The Bloom filter of the values that ``hashes`` (one long column, or what
    ``read`` makes of it) may hold ``least`` times (1 or 2), as packed bits, and
    its number of segments."""
    spark = session(hashes)
    filter_bits = min(MAX_FILTER_BITS, max(1 << 13, _power_of_two(8 * rows)))
    segments = min(_power_of_two(rows / SEGMENT_HASHES * 4), filter_bits >> 9)
    segments = max(16, segments)
    local = hashes.mapInArrow(releasing(_local_pass(segments, least, read)), "segment long, hashes binary, twice binary")
    dealt = local.repartition(min(segments, shuffle_partitions(spark)), "segment").sortWithinPartitions("segment")
    seen_bits = min(max(_power_of_two(16 * rows / segments), SEGMENT_BITS[0]), SEGMENT_BITS[1])
    merged = dealt.mapInArrow(releasing(_merge_pass(segments, filter_bits, seen_bits)), "segment long, bits binary")
    packed = np.zeros(filter_bits // 8, np.uint8)
    width = filter_bits // segments // 8
    for row in merged.collect():  # filter_bits / 8 bytes in all, by construction
        packed[row.segment * width:(row.segment + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return packed, segments


def membership(packed: np.ndarray, segments: int):
    """A test of 64-bit values against a filter."""
    chunk_bits = len(packed) * 8 // segments

    def hold(v: np.ndarray) -> np.ndarray:
        at = _positions(_remixed(v), chunk_bits) + _segment_of(v, segments)[None, :] * chunk_bits
        return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)

    return hold


def may_hold(packed_broadcast, segments: int):
    """A UDF that tests a long column against a broadcast filter."""

    @F.arrow_udf(T.BooleanType())
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(membership(packed_broadcast.value, segments)(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    return maybe


def lowered_digests(text: pa.Array) -> list[bytes]:
    """SHA-256 of each text's UTF-8 after lower-casing A-Z only (null: empty).

    Spark's ``translate`` does the same letter by letter, which takes ten times as
    long as all else here together; ``bytes.lower`` changes ASCII letters alone.
    """
    data, at = string_bytes(text)
    view = memoryview(data)
    return [hashlib.sha256(bytes(view[a:b]).lower()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_TESTED = T.StructType([T.StructField("sha", T.StringType()), T.StructField("maybe", T.BooleanType())])


def _tested(packed_broadcast, segments: int):
    """Digest and filter test of a text in one go."""

    @F.arrow_udf(_TESTED)
    def tested(text: pa.Array) -> pa.Array:
        digests = lowered_digests(text)
        heads = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
        maybe = membership(packed_broadcast.value, segments)(heads)
        return pa.StructArray.from_arrays([pa.array([d.hex() for d in digests], pa.string()), pa.array(maybe, pa.bool_())], ["sha", "maybe"])

    return tested.asNondeterministic()  # else a filter on it would have it evaluated twice


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``text_sha256``, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    an empty one, and all empty texts form one group. Of a group the largest
    ``doc_id`` stays; null ids are smaller than all others, and a group of null
    ids only keeps a null. Rows that repeat both id and text are one document:
    they stay or go together, and count in ``group_size``. Other columns, of
    whatever name, pass through; result columns replace those of the same name.
    An empty table gives an empty result.
    """
    spark = session(docs)
    results = ("text_sha256", "keep_id", "group_size", "kept")
    docs = docs.drop(*(c for c in results if c not in (text, doc_id)))
    packed, segments = value_filter(docs.select(F.col(text).alias("text")), docs.count(), read=_digest_heads)
    tested = _tested(spark.sparkContext.broadcast(packed), segments)
    tag = "__quill"
    sha = f"{tag}.sha"
    hashed = docs.withColumn(tag, tested(F.col(text)))
    single = hashed.where(f"not {tag}.maybe").select(
        *docs.columns, F.col(sha).alias("text_sha256"), F.col(doc_id).alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    again = hashed.where(f"{tag}.maybe")
    groups = again.groupBy(F.col(sha).alias(f"{tag}_group")).agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "groups")  # so that both sides of the join are plain exchanges, which can be split
    again = again.withColumn("text_sha256", F.col(sha)).join(groups, F.col("text_sha256") == F.col(f"{tag}_group"))
    out = single.unionByName(again.select(*docs.columns, "text_sha256", "keep_id", "group_size"))
    return out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))
