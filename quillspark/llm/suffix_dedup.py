"""Removal of repeated substrings by sorting suffixes (deep-shallow).

A substring of ``least`` bytes that starts in two places is found through a
content-chosen *anchor*: of the ``span`` k-grams inside a window of ``least``
bytes the one with the smallest hash, the first of equals. Equal windows choose
equal anchors at equal offsets, so all windows that can match meet under their
anchor, and only about 2 / span of all positions take part:

1. A Bloom filter of anchor hashes seen twice drops the other anchors before
   any shuffle.
2. Of the rest the *context* (every window through the anchor) is stored. Equal
   contexts are counted, bytes compared, by aggregates with map-side partials;
   distinct ones are dealt by anchor hash, each with its count.
3. A task compares the k-grams of an anchor hash and puts the suffixes to the
   right and (reversed) to the left of the anchor in deep-shallow order. A window
   with a bytes to the left of the anchor repeats if the suffixes that share both
   its left interval at depth a and its right one at depth span - 1 - a came twice
   or more in all, which is a lookup of interval numbers, not of pairs.
4. Covered intervals go back to the texts that have any (again through a
   bounded Bloom filter); other texts never shuffle.

In periodic text every window repeats where the period ends; such a window is
compared with its predecessor in place and chooses no anchor, so long runs
have no more anchors than other text.

A group of more than ``LARGE`` distinct contexts is split by prefixes before it is
sorted: the windows with a to b bytes left of the anchor all share a bytes on that
side and span - 1 - b on the other, so halving the range makes longer keys, of
smaller groups, and cuts off the bytes that no window of the range has, which makes
more contexts equal. At one window the key is all there is left.
Texts are identified by two 64-bit hashes: equal texts have equal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import discard, materialise, session
from .exact_dedup import may_hold, membership, value_filter
from .suffix_sort import adjacent_lcp, suffix_order

LEAST = 200
#: Contexts that one task sorts at a time.
TOGETHER = 16_384
#: Distinct contexts of one group; a larger one is split.
LARGE = TOGETHER // 4
#: Bytes whose windows are looked at together, whatever the length of a text.
PIECE = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)


def digest(*columns) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of columns."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def gram(least: int) -> tuple[int, int]:
    """Length of the k-grams, and how many of them a window of ``least`` bytes has."""
    k = max(1, least // 4)
    return k, least - k + 1


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width], by running minima from both block ends."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.concatenate([values, np.repeat(values[-1:], blocks * width - len(values))]).reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _same_before(data: np.ndarray, at: np.ndarray, back: np.ndarray, least: int) -> np.ndarray:
    """Whether the window at each place equals the one ``back`` bytes before it."""
    out = np.zeros(len(at), bool)
    for d in np.unique(back).tolist():
        some = np.flatnonzero(back == d)
        first, last = int(at[some[0]]), int(at[some[-1]]) + least
        same = np.zeros(last - first + 1, np.int32)
        np.cumsum(data[first:last] == data[first - d:last - d], out=same[1:])
        x = at[some] - first
        out[some] = same[x + least] - same[x] == least
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the texts in ``data``, and the (start,
    end) ranges, one row each, of windows that repeat by their own period."""
    k, span = gram(least)
    lengths = np.diff(offsets)
    valid = np.zeros(len(data) + 2, np.int32)
    np.add.at(valid, offsets[:-1][lengths >= least], 1)
    np.add.at(valid, offsets[1:][lengths >= least] - least + 1, -1)
    valid = np.cumsum(valid)[: len(data)] > 0  # windows that cross texts choose nothing
    found_at, found_h, found_runs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros((0, 2), np.int64)]
    for a in range(0, len(data), PIECE):
        lo, hi = max(0, a - span), min(len(data), a + PIECE + least - 1)
        if hi - lo < least:
            continue
        sub = data[lo:hi]
        prefix = textvec.prefix_hash(sub)
        at = np.arange(len(sub) - k + 1)
        h = textvec.range_hash(prefix, at, at + k)
        low = _sliding_min(h & ~_PLACE | at.astype(np.uint64), span)  # by hash, then place
        window = np.flatnonzero(valid[lo:lo + len(low)])
        chosen = (low[window] & _PLACE).astype(np.int64)
        own = window >= a - lo
        if own.any():
            # the anchor before, if it is the same k-gram: one period back
            places, which = np.unique(chosen, return_inverse=True)
            gap = np.zeros(len(places), np.int64)
            gap[1:] = np.where(h[places[1:]] == h[places[:-1]], np.diff(places), 0)
            back = gap[which]
            start = offsets[np.searchsorted(offsets, window + lo, "right") - 1] - lo
            may = np.flatnonzero(own & (back > 0) & (back < span) & (window - back >= np.maximum(start, 0)))
            again = may[_same_before(sub, window[may], back[may], least)]
            if len(again):
                found_runs.append(_merged(window[again] - back[again] + lo, window[again] + least + lo, 0))  # texts may touch
                own[again] = False
            mine = np.unique(chosen[own])
            found_at.append(mine + lo)
            found_h.append(h[mine])
    at, first = np.unique(np.concatenate(found_at), return_index=True)
    return at, np.concatenate(found_h)[first], np.concatenate(found_runs)


def _merged(lo: np.ndarray, hi: np.ndarray, gap: int = 1) -> np.ndarray:
    """The union of ranges as (start, end) rows, in order; rows are ``gap`` or more apart."""
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(lo)), bool), lo[1:] >= far[:-1] + gap]))
    return np.stack([lo[first], far[np.append(first[1:], len(lo)) - 1]], axis=1) if len(lo) else np.zeros((0, 2), np.int64)


def _anchor_hashes(least: int):
    def read(batch: pa.RecordBatch):
        for part in textvec.chunks(batch, "text"):
            yield anchors(*textvec.string_bytes(part.column("text")), least)[1]

    return read


_ROWS = "k1 long, k2 long, pos long, h long, left int, c1 long, c2 long, n long, context binary"
#: What n says of a row besides "a context and its count".
RUN, MEMBER = -1, 0
#: Distinct contexts that a task counts before it passes them on.
COUNTED = 1 << 15


def _context_rows(least: int, wanted, segments: int):
    """For anchors whose hash the filter may hold a row each (MEMBER) with their place
    and their context's digest; of the contexts themselves, counted, a row each; and
    ranges that repeat by their own period (RUN; pos and h are start and end)."""
    _, span = gram(least)

    def batch_of(k1, k2, pos, h, left, c, n, context):
        c = np.frombuffer(b"".join(c), np.int64).reshape(-1, 2)
        columns = [k1, k2, pos, h, pa.array(left, pa.int32()), pa.array(c[:, 0]), pa.array(c[:, 1]), n, pa.array(context, pa.binary())]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], _NAMES)

    def passed_on(counted: dict):
        columns = [[r[i] for r in counted.values()] for i in range(6)]
        return batch_of(*columns[:4], [left for left, _ in counted], columns[4], columns[5], [context for _, context in counted])

    def run(batches):
        hold, counted = membership(wanted.value, segments), {}
        for batch in batches:
            for part in textvec.chunks(batch, "text"):
                data, offsets = textvec.string_bytes(part.column("text"))
                at, h, runs = anchors(data, offsets, least)
                some = hold(h)
                at, h = at[some], h[some].view(np.int64)
                k1, k2 = part.column("k1"), part.column("k2")
                if len(runs):
                    owner = np.searchsorted(offsets, runs[:, 0], "right") - 1
                    lo, hi = runs[:, 0] - offsets[owner], runs[:, 1] - offsets[owner]
                    none = np.zeros(len(runs), np.int64)
                    yield batch_of(k1.take(pa.array(owner)), k2.take(pa.array(owner)), lo, hi, none, [bytes(16)] * len(runs), none + RUN, [None] * len(runs))
                if not len(at):
                    continue
                owner = np.searchsorted(offsets, at, "right") - 1
                a, b = np.maximum(at - (span - 1), offsets[owner]), np.minimum(at + least, offsets[owner + 1])
                view, pos, left = memoryview(data), at - offsets[owner], at - a
                contexts = [(place, bytes(view[x:y])) for place, x, y in zip(left.tolist(), a.tolist(), b.tolist())]
                c = [hashlib.blake2b(x, digest_size=16, key=place.to_bytes(8, "little")).digest() for place, x in contexts]
                own1, own2 = k1.take(pa.array(owner)), k2.take(pa.array(owner))
                yield batch_of(own1, own2, pos, h, left, c, np.full(len(at), MEMBER), [None] * len(at))
                for key, *row in zip(contexts, own1.to_pylist(), own2.to_pylist(), pos.tolist(), h.tolist(), c):
                    held = counted.setdefault(key, [*row, 0])
                    held[5] += 1
                if len(counted) > COUNTED:
                    yield passed_on(counted)
                    counted = {}
        if counted:
            yield passed_on(counted)

    return run


_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _sides(contexts: list[bytes], left: np.ndarray, least: int):
    """Matrices of symbols: the anchor's k-gram, what is to its right and, reversed, to its left."""
    k, span = gram(least)
    reach = span - 1
    size = np.array([len(c) for c in contexts], np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    middle = np.cumsum(size) - size + left  # where the k-grams start
    right_len = size - left - k
    at = np.arange(reach)
    right = np.where(at < right_len[:, None], raw[np.minimum(middle[:, None] + k + at, len(raw) - 1)] + 1, 0).astype(np.uint8)
    back = np.where(at < left[:, None], raw[np.maximum(middle[:, None] - 1 - at, 0)] + 1, 0).astype(np.uint8)
    return raw[middle[:, None] + np.arange(k)], right, right_len, back, left


def _grams_apart(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Numbers of the groups of rows that have one hash and one k-gram."""
    group = np.unique(h, return_inverse=True)[1]
    first = np.unique(group, return_index=True)[1]
    if (grams == grams[first[group]]).all():
        return group
    each = np.ascontiguousarray(np.concatenate([h[:, None].view(np.uint8).reshape(len(h), 8), grams], axis=1))
    return np.unique(each.view(f"V{each.shape[1]}").ravel(), return_inverse=True)[1]


def repeated_reach(h: np.ndarray, times: np.ndarray, contexts: list[bytes], left: np.ndarray, least: int):
    """For each context the largest and the smallest a such that its window with a
    bytes to the left of the anchor repeats (-1: none)."""
    _, span = gram(least)
    reach = span - 1
    grams, right, right_len, back, left_len = _sides(contexts, left, least)
    group = _grams_apart(h, grams)
    n = len(contexts)
    lanes = []
    for rows, length in ((back, left_len), (right, right_len)):
        order = suffix_order(rows, group)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        lanes.append((adjacent_lcp(rows, order, length, group), place, length))
    (lcp_l, place_l, len_l), (lcp_r, place_r, len_r) = lanes
    most, fewest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    shared = (np.bincount(group)[group] > 1) | (times > 1)  # a context alone in its group has no partner
    for a in range(reach + 1):
        fits = np.flatnonzero(shared & (len_l >= a) & (len_r >= reach - a))
        if not len(fits):
            continue
        interval_l, interval_r = np.cumsum(lcp_l < a), np.cumsum(lcp_r < reach - a)
        both = interval_l[place_l[fits]] * (n + 1) + interval_r[place_r[fits]]
        order = np.argsort(both, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        total = np.add.reduceat(times[fits][order], start)
        again = np.repeat(total >= 2, np.diff(np.append(start, len(order))))
        x = fits[order[again]]
        most[x] = a
        fewest[x] = np.where(fewest[x] < 0, a, fewest[x])
    return most, fewest


_OWN = ["k1", "k2", "pos", "c1", "c2", "n"]


def _sorted_reach(distinct: DataFrame, least: int, own: list[str]) -> DataFrame:
    """Distinct contexts, ordered by h within partitions, to what the repeated windows
    of each that has any cover, relative to the anchor, beside the columns ``own``."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            h, left, n = (table.column(c).to_numpy() for c in ("h", "left", "n"))
            most, fewest = repeated_reach(h, n, table.column("context").to_pylist(), left.astype(np.int64), least)
            some = pa.array(np.flatnonzero(most >= 0))
            most, fewest = most[some], fewest[some]
            kept = table.select(own).take(some).combine_chunks()
            columns = [kept.column(c).combine_chunks() for c in own]
            return pa.RecordBatch.from_arrays([*columns, pa.array(-most), pa.array(least - fewest)], [*own, "lo", "hi"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last hash may go on
                if cut:
                    yield work(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    rows = sum(b.num_rows for b in held)
        if rows:
            yield work(pa.Table.from_batches(held))

    kinds = T.StructType([distinct.schema[c] for c in own]).add("lo", "long").add("hi", "long")
    return distinct.mapInArrow(textvec.releasing(run), kinds)


def _large(groups: DataFrame, large: int) -> DataFrame:
    """The hashes of groups with more than ``large`` distinct rows."""
    kinds = groups.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    return materialise(kinds.where(F.col("kinds") > large).select("h"), "large-groups")


def _split_reach(contexts: DataFrame, many: DataFrame, least: int, large: int) -> DataFrame:
    """What ``_sorted_reach`` gives for the contexts of the groups ``many``, by way of
    groups of ranges of their windows. A range that is larger yet is halved again."""
    k, span = gram(least)
    left, a, b, mid = (F.col(c) for c in ("left", "a", "b", "mid"))
    right = F.octet_length("context") - left - k
    open_ = contexts.withColumns({"a": F.lit(0), "b": F.lit(span - 1)})
    ready, written = None, []
    while not many.isEmpty():
        mid_ = F.floor((a + b) / 2).cast("int")
        halves = open_.join(many, "h").withColumn("mid", mid_)
        halves = halves.withColumn("part", F.explode(F.array(F.struct(a.alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), b.alias("b")))))
        halves = halves.select(*_OWN, "h", "left", "context", "part.a", "part.b").where((left >= a) & (right >= span - 1 - b))
        key = F.xxhash64("h", "a", "b", F.substring("context", left - a + 1, a + k + span - 1 - b))
        before, after = F.least(left, b), F.least(right, span - 1 - a)
        seen = F.substring("context", left - before + 1, before + k + after)
        open_ = materialise(halves.select(*_OWN, key.alias("h"), before.alias("left"), seen.alias("context"), "a", "b"), "split")
        many = _large(open_.where("a < b").select("h", "left", "context"), large)
        written += [open_, many]
        done = open_.join(many, "h", "left_anti")
        ready = done if ready is None else ready.unionByName(done)
    same = ["h", "left", "context"]
    distinct = ready.groupBy(*same).agg(F.sum("n").alias("n")).repartition("h").sortWithinPartitions("h")
    reach = materialise(_sorted_reach(distinct, least, same), "split-reach")
    out = materialise(ready.join(reach, same).select(*_OWN, "lo", "hi"), "large-reach")
    discard(*written, reach)
    return out


def repeated_intervals(texts: DataFrame, least: int = LEAST, large: int = LARGE) -> DataFrame:
    """(k1, k2, spans) for every distinct text of ``texts`` (column ``text``) in which a
    string of ``least`` bytes also starts elsewhere; spans may overlap and exceed it."""
    spark = session(texts)
    _, span = gram(least)
    k1, k2 = digest("text")
    texts = texts.where(F.octet_length("text") >= least).select("text", k1.alias("k1"), k2.alias("k2"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed, segments = value_filter(texts.select("text"), 1 + 2 * size // span, read=_anchor_hashes(least))
    twice = spark.sparkContext.broadcast(packed)
    found = materialise(texts.mapInArrow(textvec.releasing(_context_rows(least, twice, segments)), _ROWS), "contexts")
    runs = found.where(F.col("n") == RUN).select("k1", "k2", F.col("pos").alias("lo"), F.col("h").alias("hi"))
    contexts = found.where("n > 0")
    many = _large(contexts.select("h", "c1", "c2"), large)
    none_large = many.isEmpty()
    distinct = contexts if none_large else contexts.join(many, "h", "left_anti")
    # one shuffle by h serves the counting and the sorting
    distinct = _distinct(distinct.repartition("h")).sortWithinPartitions("h")
    reach = materialise(_sorted_reach(distinct, least, _OWN), "reach")
    tables = [found, many, reach]
    if not none_large:
        whole = materialise(_distinct(contexts.join(many, "h")), "large-contexts")
        tables += [whole, _split_reach(whole, many, least, large)]
        reach = reach.unionByName(tables[-1])
    place = [(F.col("pos") + F.col(c)).alias(c) for c in ("lo", "hi")]
    once = reach.where("n = 1").select("k1", "k2", *place)
    members = found.where(F.col("n") == MEMBER).select("k1", "k2", "pos", "c1", "c2")
    often = members.join(reach.where("n > 1").select("c1", "c2", "lo", "hi"), ["c1", "c2"]).select("k1", "k2", *place)
    spans = once.unionByName(often).unionByName(runs).distinct()
    out = materialise(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(*tables)
    return out


def _distinct(contexts: DataFrame) -> DataFrame:
    """Contexts with their counts over all tasks; k1, k2, pos: the one place of those that came once."""
    own = [F.min(c).alias(c) for c in ("k1", "k2", "pos")]
    return contexts.groupBy("h", "left", "c1", "c2", "context").agg(F.sum("n").alias("n"), *own)


def _cutter(kept_text: bool):
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    kinds |= {"kept_text": pa.string()} if kept_text else {}
    types = {pa.int64(): T.LongType(), pa.string(): T.StringType()}

    def piece(text: pa.Array, spans: pa.Array) -> pa.Array:
        data, offsets = textvec.string_bytes(text)
        view, out = memoryview(data), {name: [] for name in kinds}
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            n, own, runs = b - a, spans[i], []
            if own.is_valid:
                lo, hi = (own.values.field(c).to_numpy() for c in ("lo", "hi"))
                runs = _merged(np.maximum(lo, 0), np.minimum(hi, n)).tolist()
            cuts = [0, *(x for run in runs for x in run), n]
            kept = b"".join(view[a + x:a + y] for x, y in zip(cuts[::2], cuts[1::2]))
            out["n_bytes"].append(n)
            out["n_removed"].append(n - len(kept))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if kept_text:
                out["kept_text"].append(kept.decode("utf-8", "ignore"))
        return pa.StructArray.from_arrays([pa.array(out[c], kinds[c]) for c in kinds], list(kinds))

    @F.arrow_udf(T.StructType([T.StructField(name, types[kind]) for name, kind in kinds.items()]))
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, spans in batches:  # many MB; the kept texts go back in small pieces
            for part in textvec.chunks(pa.RecordBatch.from_arrays([text, spans], ["text", "spans"]), "text"):
                yield piece(part.column("text"), part.column("spans"))
        textvec.release()

    return cut.asNondeterministic()  # else a filter on it would have it evaluated twice


def remove_repeats(docs: DataFrame, *, text: str = "text", least: int = LEAST, large: int = LARGE, kept_text: bool = True) -> DataFrame:
    """``docs`` and a struct ``cut``: n_bytes, n_removed, n_spans, kept_sha256 and,
    unless ``kept_text`` is off, kept_text.

    Every byte covered by a string of ``least`` bytes that also starts anywhere
    else in the column, the same text included, is removed; matches don't cross
    rows, and all are judged on the input. So equal long texts go entirely. A
    null text is an empty one; shorter texts than ``least`` stay whole. In
    ``kept_text`` a letter of which some bytes were removed is dropped. Null and
    repeated ids don't matter, other columns pass through (one named ``cut`` is
    replaced), and an empty table gives an empty result.
    """
    spark = session(docs)
    spans = repeated_intervals(docs.select(F.col(text).alias("text")), least, large)
    packed, segments = value_filter(spans.select("k1"), spans.count(), least=1)
    maybe = may_hold(spark.sparkContext.broadcast(packed), segments).asNondeterministic()
    tag = "__quill"
    k1, k2 = digest(F.col(text))
    keyed = docs.drop("cut").withColumn(f"{tag}_1", k1).withColumn(f"{tag}_2", k2).withColumn(f"{tag}_some", maybe(f"{tag}_1"))
    spans = spans.withColumnsRenamed({"k1": f"{tag}_a", "k2": f"{tag}_b", "spans": f"{tag}_spans"})
    same = (F.col(f"{tag}_1") == F.col(f"{tag}_a")) & (F.col(f"{tag}_2") == F.col(f"{tag}_b"))
    # never a broadcast: the filter and the cutting would be two Python workers for each task
    some = keyed.where(f"{tag}_some").join(spans.hint("merge"), same, "left")
    some = some.withColumn("cut", _cutter(kept_text)(F.col(text), F.col(f"{tag}_spans")))
    own = F.coalesce(F.col(text), F.lit(""))
    whole = [F.octet_length(own).cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans"))]
    whole += [F.sha2(own, 256).alias("kept_sha256")] + [own.alias("kept_text")] * kept_text
    none = keyed.where(f"not {tag}_some").withColumn("cut", F.struct(*whole))
    columns = [c for c in docs.columns if c != "cut"] + ["cut"]
    return some.select(*columns).unionByName(none.select(*columns))
