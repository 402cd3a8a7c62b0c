"""Token ids in training order: fixed-stride binary shards.

Every sequence of ``length`` ids gets a global slot by a keyed permutation: a
Feistel network over the smallest even number of bits that holds the count,
walked along its cycle until the value is below it. Shard s holds slots
s * per_shard onwards, one record each, so a reader can start at any slot by
arithmetic alone, and an interrupted one goes on where it was.

A record is ``HEADER`` (sequence number u64, ids in use u16) and ``length`` ids
as little-endian u16, ended by one line end: Spark's text writer puts it there,
which writes the bytes of a string column as they are, to any store.

Sequences are cut from the documents of an input partition, joined with the end
id between them, so nothing but a partition's last sequence is padded. Their
numbers need the counts of the partitions before; a first pass over the same
partitions takes these, and the second one fails rather than write anything if
a partition doesn't hold what it did. Only that second pass shuffles, ids only.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, shuffle_partitions
from .textvec import chunks, mixed, releasing

LENGTH, PER_SHARD, END_ID, ROUNDS = 1024, 4096, 2, 6
#: Records that a task makes or reads at a time.
BLOCK = 512
HEADER = np.dtype([("sequence", "<u8"), ("used", "<u2")])


def feistel(values: np.ndarray, count: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0..count-1 chosen by ``key``, applied to ``values``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [mixed(np.array([key + 0x9E37 * r], np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0] for r in range(ROUNDS)]
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mixed(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mixed(right ^ k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(count)]  # outside: walk on along the cycle
    return out.astype(np.int64)


@dataclass
class Layout:
    """All that a reader needs; stored beside the shards as JSON."""

    path: str
    sequences: int
    shards: int
    per_shard: int
    length: int
    key: int

    @property
    def stride(self) -> int:
        return HEADER.itemsize + 2 * self.length + 1

    def place(self, slot: int) -> tuple[int, int]:
        """Shard and byte offset of a slot."""
        return slot // self.per_shard, slot % self.per_shard * self.stride


def _stream(batches, tokenizer: str, ranks: str | None, length: int, end_id: int):
    """Full sequences of a partition's ids, several at a time, then what is left."""
    from .tokens import encoder

    enc, rest = encoder(tokenizer, ranks), np.zeros(0, np.uint16)
    for batch in batches:
        for part in chunks(batch, "text"):
            flat, at = enc.encode([t or "" for t in part.column("text").to_pylist()])
            if len(flat) and flat.max() > 0xFFFF:
                raise ValueError("ids over 65535 don't fit into two bytes")
            ids = np.concatenate([rest, np.insert(flat, at[1:], end_id).astype(np.uint16)])
            full = len(ids) // length * length
            yield ids[:full].reshape(-1, length)
            rest = ids[full:]
    if len(rest):
        yield rest[None, :]


def _count(tokenizer, ranks, length):
    def run(batches):
        from .tokens import encoder

        enc, ids = encoder(tokenizer, ranks), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                ids += enc.count([t or "" for t in part.column("text").to_pylist()]) + part.num_rows  # an end id each
        n = -(-ids // length)
        yield pa.RecordBatch.from_pydict({"partition": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64())})

    return run


def _records(tokenizer, ranks, length, end_id, starts, counts, total, key, per_shard):
    def run(batches):
        partition = TaskContext.get().partitionId()
        at, end = int(starts.value[partition]), int(starts.value[partition] + counts.value[partition])
        for rows in _stream(batches, tokenizer, ranks, length, end_id):
            for block in range(0, len(rows), BLOCK):
                part = rows[block:block + BLOCK]
                n = len(part)
                out = np.zeros((n, HEADER.itemsize + 2 * length), np.uint8)
                header = np.zeros(n, HEADER)
                header["sequence"], header["used"] = np.arange(at, at + n), part.shape[1]
                out[:, : HEADER.itemsize] = header.view(np.uint8).reshape(n, -1)
                out[:, HEADER.itemsize:HEADER.itemsize + 2 * part.shape[1]] = np.ascontiguousarray(part).view(np.uint8).reshape(n, -1)
                slot = feistel(np.arange(at, at + n), total, key)
                at += n
                if at > end:
                    raise RuntimeError("a partition holds more sequences than when they were counted")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot // per_shard), pa.array(slot), pa.array([r.tobytes() for r in out], pa.binary())], ["shard", "slot", "record"]
                )
        if at != end:
            raise RuntimeError("a partition holds fewer sequences than when they were counted")

    return run


def write_shards(
    docs: DataFrame, path: str, tokenizer_json: str, ranks_file: str | None = None, *, text: str = "text",
    length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID, key: int = 0,
) -> Layout:
    """Writes all whole texts of ``docs`` under ``path`` and says how they lie there.

    ``docs`` should read a table as it is (no shuffle before), so that its
    partitions come again. A null text is an empty one (the end id alone); ids,
    repeated rows and other columns don't matter. An empty table writes no shards.
    """
    spark = session(docs)
    texts = docs.select(F.col(text).alias("text"))
    how = (tokenizer_json, ranks_file, length, end_id)
    found = {r["partition"]: r["n"] for r in texts.mapInArrow(releasing(_count(*how[:3])), "partition long, n long").collect()}  # a row per input split
    counts = np.array([found.get(i, 0) for i in range(max(found, default=-1) + 1)], np.int64)
    total = int(counts.sum())
    layout = Layout(path, total, -(-total // per_shard), per_shard, length, key)
    if total:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        shared = [spark.sparkContext.broadcast(x) for x in (starts, counts)]
        records = texts.mapInArrow(releasing(_records(*how, *shared, total, key, per_shard)), "shard long, slot long, record binary")
        tasks = min(layout.shards, max(shuffle_partitions(spark), 1))
        ranged = records.repartitionById(tasks, (F.col("shard") * tasks / layout.shards).cast("int"))  # ranges of whole shards
        ranged = ranged.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
        # the writer wants rows by shard; within one they lie by slot
        ranged.write.partitionBy("shard").option("lineSep", "\n").text(path)
    spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string").coalesce(1).write.mode("append").text(f"{path}-layout")
    return layout


def read_layout(spark: SparkSession, path: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{path}-layout").first()["value"]))


def read_slots(spark: SparkSession, layout: Layout, first: int = 0, last: int | None = None, with_ids: bool = False) -> DataFrame:
    """Slots first..last-1 as read from their places in the shards, with the ids'
    CRC-32 (little-endian u32, those in use) and whether each slot is the one that
    the key gives its sequence. Only shards that hold such slots are read."""
    last = layout.sequences if last is None else min(last, layout.sequences)
    fields = [
        ("slot", T.LongType(), pa.int64()), ("shard", T.LongType(), pa.int64()), ("position", T.LongType(), pa.int64()), ("sequence", T.LongType(), pa.int64()),
        ("n_tokens", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64()), ("slot_is_keyed", T.BooleanType(), pa.bool_()),
    ] + [("ids", T.BinaryType(), pa.binary())] * with_ids
    schema = T.StructType([T.StructField(name, kind) for name, kind, _ in fields])
    if last <= first:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(layout.path)
    files = files.where(F.col("shard").between(first // layout.per_shard, (last - 1) // layout.per_shard))

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                if len(data) % layout.stride:
                    raise RuntimeError(f"shard {shard} isn't a whole number of records")
                data = data.reshape(-1, layout.stride)
                for at in range(0, len(data), BLOCK):
                    yield block(shard, at, data[at:at + BLOCK])

    def block(shard: int, at: int, data: np.ndarray) -> pa.RecordBatch:
        slot = shard * layout.per_shard + at + np.arange(len(data))
        keep = (slot >= first) & (slot < last)
        data, slot = data[keep], slot[keep]
        header = np.ascontiguousarray(data[:, : HEADER.itemsize]).view(HEADER).ravel()
        ids = np.ascontiguousarray(data[:, HEADER.itemsize:-1]).view("<u2").astype("<u4")
        raw = [row[:n].tobytes() for row, n in zip(ids, header["used"].tolist())]
        keyed = feistel(header["sequence"].astype(np.int64), layout.sequences, layout.key) == slot
        values = [slot, np.full(len(slot), shard), slot % layout.per_shard, header["sequence"].astype(np.int64), header["used"].astype(np.int64), [zlib.crc32(r) for r in raw], keyed]
        values += [raw] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, _, kind) in zip(values, fields)], schema.names)

    return files.select(F.col("shard").cast("long"), "content").mapInArrow(releasing(run), schema)
