"""Best-fit packing of documents into fixed-length sequences.

Lengths are integers from 1 to the capacity, so the bin-packing instance *is* a
histogram: at most ``capacity`` counters, whatever the size of the corpus. Only
that histogram reaches the driver, which

1. fixes item sets by Martello-Toth dominance (``reduce_by_dominance``): while
   the set {largest item} + at most two others provably dominates every other
   feasible set with that item, it is made permanent and the instance shrinks;
2. packs what remains by best-fit decreasing on the counters (``best_fit``).

Both work on groups of equal bins, so the plan is a list of *patterns* (lengths
in one bin, number of such bins). There are at most a few thousand of them for
any input: every step uses up a length or a class of bins, and of these there
are no more than 4 * capacity. The plan is broadcast as arrays; a piece finds
its sequence and offset from its rank among the pieces of its length. The rank
is counted in salted buckets, so a length that most pieces share is no hot key.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, session, shuffle_partitions
from .textvec import chunks, releasing

CAPACITY = 1024
END_ID = 2
Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), largest first


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Takes sets that dominate all alternatives out of ``counts`` (in place).

    A feasible set dominates another if the other's items can be split into
    groups, each no longer in total than an item of the first set matched to it
    alone. For the largest item j, with room r = capacity - j:

    * nothing else fits: {j};
    * an item k = r fits exactly: {j, k}, as any others go into k's place;
    * at most one more fits: {j, largest that fits};
    * at most two more fit: {j, k} if k is no shorter than any feasible pair in
      total, else {j, a, b} (a the largest that fits, b the largest beside a) if
      the shorter item of no feasible pair is longer than b.

    Taking items away only removes alternatives, so a set that dominates may be
    repeated until one of its lengths is used up.
    """
    fixed: list[tuple[Pattern, int]] = []
    progress = True
    while progress:
        progress = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                items = _dominating(counts, j, capacity)
                if items is None:
                    break
                need = Counter(items)
                n = min(int(counts[x]) // k for x, k in need.items())
                for x, k in need.items():
                    counts[x] -= n * k
                fixed.append((tuple(sorted(need.items(), reverse=True)), n))
                progress = True
    return fixed


def _dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    counts[j] -= 1
    try:
        fits = np.flatnonzero(counts[1:room + 1] > 0) + 1
        if not len(fits):
            return (j,)
        k = int(fits[-1])
        if k == room:
            return (j, k)
        smallest = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3).astype(int))[:3]
        if len(smallest) < 2 or smallest[:2].sum() > room:
            return (j, k)
        if len(smallest) == 3 and smallest.sum() <= room:
            return None  # three more may fit: no cheap proof
        best_pair, longest_second = 0, 0
        for y in fits:
            if 2 * y > room:
                break
            x = int(fits[np.searchsorted(fits, room - y, "right") - 1])  # the longest partner
            if x < y or (x == y and counts[y] < 2):
                continue
            best_pair, longest_second = max(best_pair, int(x + y)), max(longest_second, int(y))
        if k >= best_pair:
            return (j, k)
        beside = fits[(fits <= room - k) & (counts[fits] - (fits == k) > 0)]
        if len(beside) and beside[-1] >= longest_second:
            return (j, k, int(beside[-1]))
        return None
    finally:
        counts[j] += 1


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing; ``counts`` holds the items by length."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)

    def put(pattern: Pattern, room: int, length: int, each: int, n: int) -> None:
        if n:
            open_bins[room - length * each].append((pattern + ((length, each),), n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), None)
            if room is None:
                each = capacity // length
                put((), capacity, length, each, left // each)
                if left % each:
                    put((), capacity, length, left % each, 1)
                break
            pattern, bins = open_bins[room].pop()
            each = room // length
            if left >= bins * each:
                put(pattern, room, length, each, bins)
                left -= bins * each
                continue
            put(pattern, room, length, each, left // each)
            if left % each:
                put(pattern, room, length, left % each, 1)
            rest = bins - left // each - (left % each > 0)
            if rest:
                open_bins[room].append((pattern, rest))
            left = 0
    return [x for same in open_bins.values() for x in same]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    counts = counts.astype(np.int64).copy()
    return reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)


_RANK_BITS = 48


def slot_arrays(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For searches by (length, rank): first rank of a slot run, its first
    sequence, items of the length in one bin, and where in a bin they start."""
    rows, filled, sequence = [], defaultdict(int), 0
    for pattern, bins in patterns:
        offset = 0
        for length, each in pattern:
            rows.append(((length << _RANK_BITS) + filled[length], sequence, each, offset))
            filled[length] += bins * each
            offset += length * each
        sequence += bins
    rows.sort()
    key, seq, each, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": key, "sequence": seq, "each": each, "offset": offset}


def token_pieces(
    docs: DataFrame, tokenizer_json: str, ranks_file: str | None = None, *,
    text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """Ids of every whole text and the end id, cut into pieces of at most
    ``capacity``; of a longer document the first piece takes the remainder."""
    session(docs)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [
        T.StructField("doc_id", chosen.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.BinaryType())] * keep_ids

    def run(batches):
        from .tokens import encoder

        enc = encoder(tokenizer_json, ranks_file)
        for batch in batches:
            for part in chunks(batch, "text"):
                flat, at = enc.encode([t or "" for t in part.column("text").to_pylist()])
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        data = own[x:y].tobytes()
                        owner.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(data))
                        ids.append(data)
                columns = [
                    part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ] + [pa.array(ids, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return chosen.mapInArrow(releasing(run), T.StructType(fields))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) and the ``sequence_id`` and ``offset`` of each.

    ``pieces`` must be stored rows (a table or checkpoint), as they are read
    more than once. Rows that are the same in every column are interchangeable.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    slots = spark.sparkContext.broadcast(slot_arrays(plan(counts, capacity)))

    own = [c for c in pieces.columns if c != "ids"]
    salted = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*own), F.lit(16 * shuffle_partitions(spark))))
    sizes = salted.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("__n")
    sizes = sizes.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), before.alias("__before"))
    local = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*own)) - 1
    ranked = salted.withColumn("__local", local)
    joined = ranked.join(sizes, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    joined = joined.select(*pieces.columns, (F.col("__before") + F.col("__local")).alias("__rank"))

    def run(batches):
        s = slots.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = np.searchsorted(s["key"], (length << _RANK_BITS) + rank, "right") - 1
            nth = rank - (s["key"][at] & ((1 << _RANK_BITS) - 1))
            sequence = s["sequence"][at] + nth // s["each"][at]
            offset = s["offset"][at] + nth % s["each"][at] * length
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    fields = [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return joined.mapInArrow(releasing(run), T.StructType(fields))


def pack(docs: DataFrame, tokenizer_json: str, ranks_file: str | None = None, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every document of ``docs``, packed: one row per piece with its place.

    A null text is an empty one (a piece with the end id alone); null or
    repeated ids are kept, each row being a document of its own; other columns
    are ignored, whatever their names. An empty table gives no rows. With
    ``keep_ids`` each row also carries its token ids (little-endian uint32).
    """
    pieces = materialise(token_pieces(docs, tokenizer_json, ranks_file, capacity=capacity, **options), "pieces")
    return place(pieces, capacity)
