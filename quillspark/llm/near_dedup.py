"""Near-duplicate detection by a chosen-path set similarity join.

A document is the set of its word shingles, embedded once as ``COORDINATES``
minwise tokens; their low bytes are its sketch. In each of ``TREES`` independent
trees a node picks one of these coordinates (every fourth time, on average, two:
1 / similarity branches for 0.8) and sends each of its documents to the child
named by the document's token there. Nodes of up to ``SMALL`` documents are
compared exhaustively by sketch. That is done in two steps, as sketches are most of
what a node moves: ``CODE`` coordinates at half a byte, the *code*, say which of its
documents may have a partner there, and only these bring their sketches. A larger one tests its documents against one
leader; if then all but ``OUTSIDE`` of them are in one cluster, these are
compared with all, block by block, and otherwise it branches again. A pair of
similarity s shares a chosen child with probability s or more, so by ``TREES``
repetitions a link is missed with a probability of about 1e-6 where the second
level ends its branch, and 3e-4 where the fourth does; codes add less than 1e-7.

Sketches only say who may be linked, and a node hands on a spanning forest of
that, never its pairs. What hangs together is a *cluster*; its documents come
together once, with their full shingle sets, and all its links are decided through
an inverted index. In a cluster over ``TOGETHER`` documents or ``SHINGLES``
shingles each document is first compared with one neighbour; then only those
outside the largest group that this confirms, the *open* ones, are compared with
all others, in blocks on both sides. So a large group of copies is spread over
many tasks, and its sets are copied for each block of open documents only.

What keeps groups of copies cheap: documents with equal sets are one vertex from
the start, and a node whose documents are already in one cluster is finished.
No bucket, partner or candidate is capped, nothing but a size-bounded Bloom
filter is broadcast by these operators, and joins are plain equi-joins that
adaptive execution splits when a key is hot.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import discard, materialise, release_shuffles, session
from .components import connected_components
from .exact_dedup import may_hold, membership, value_filter

COORDINATES = 128
TREES = 12
SMALL = 256
OUTSIDE = 1024
BLOCK = 2048
TOGETHER = 512
SHINGLES = 1_000_000
CODE = 48
#: Pairs of codes compared at once, a million or so of them.
PAIRS = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(0xC405E4))
_A = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text: A-Z lower-cased,
    words [^\\x20\\x09-\\x0D]+; the whole sequence is one shingle where it has
    fewer words than that, and a text without words has an empty set."""
    data, offsets = textvec.string_bytes(texts)
    data = textvec.LOWER[data]
    start, end, first = textvec.words(data, offsets)
    w = textvec.range_hash(textvec.prefix_hash(data), start, end)
    total = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        total += w[k:k + len(total)] * _STEP[k]
    shingle = textvec.mixed(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(shingle[a:b - words + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for k in range(b - a):
                short = short + w[a + k:a + k + 1] * _STEP[k]
            out.append(textvec.mixed(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise_tokens(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):
        part = shingles[None, at:at + 4096] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _embed(words: int):
    def run(batches):
        for batch in batches:
            for part in textvec.chunks(batch, "text"):
                n, k1, k2, tokens = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    key = _set_key(s)
                    n.append(len(s))
                    k1.append(int(key[0]))
                    k2.append(int(key[1]))
                    tokens.append(minwise_tokens(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(tokens, pa.binary())],
                    ["id", "n", "k1", "k2", "tokens"],
                )

    return run


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    data, offsets = textvec.string_bytes(column)
    return data.view(kind).reshape(len(offsets) - 1, -1) if len(column) else np.zeros((0, COORDINATES), kind)


def _children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of each document in each chosen branch of its node."""
    pick = textvec.mixed(path ^ np.uint64(0x5851F42D4C957F2D))
    rows = np.arange(len(path))
    first = (pick % np.uint64(COORDINATES)).astype(np.int64)
    twice = np.flatnonzero((pick >> np.uint64(40)) % np.uint64(4) == 0)
    second = (first[twice] + 1 + ((pick[twice] >> np.uint64(20)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    rows, at = np.concatenate([rows, twice]), np.concatenate([first, second])
    return rows, _child(path[rows], at, tokens[rows, at])


def _child(path: np.ndarray, at: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = path * np.uint64(0x2545F4914F6CDD1D) + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return textvec.mixed(textvec.mixed(h) + token.astype(np.uint64))


def _roots(batches):
    for batch in batches:
        ids, tokens = batch.column(0), _matrix(batch.column(1), np.uint32)
        rows, child = [], []
        for tree in range(TREES):  # the roots' coordinates are all different ones
            for at in (tree, TREES + tree)[: 1 + (tree % 4 == 3)]:
                rows.append(np.arange(len(ids)))
                child.append(_child(np.full(len(ids), tree, np.uint64), np.full(len(ids), at), tokens[:, at]))
        yield _node_rows(ids, np.concatenate(rows), np.concatenate(child))


def _branch(batches):
    for batch in batches:
        path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield _node_rows(batch.column(1), *_children(path, _matrix(batch.column(2), np.uint32)))


def _node_rows(ids: pa.Array, rows: np.ndarray, child: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), ids.take(pa.array(rows))], ["path", "id"])


def _least_matches(similarity: float) -> int:
    """Equal sketch bytes that a linked pair has, but for a chance of about 1e-6."""
    mean = COORDINATES * similarity
    return max(1, math.floor(mean - 4.8 * math.sqrt(mean * (1 - similarity))))


def _least_code_matches(similarity: float) -> int:
    """Equal places of the codes of a linked pair, but for a chance of less than 1e-7."""
    least, below = 0, (1 - similarity) ** CODE
    while below < 1e-7 and least < CODE:
        least += 1
        below += math.comb(CODE, least) * similarity**least * (1 - similarity) ** (CODE - least)
    return least


@F.arrow_udf(T.BinaryType())
def _code(sketch: pa.Array) -> pa.Array:
    half = _matrix(sketch, np.uint8)[:, :CODE] & 15
    packed = np.ascontiguousarray(half[:, ::2] | half[:, 1::2] << 4)
    return pa.array([row.tobytes() for row in packed], pa.binary())


def _code_matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal half bytes in each row of two matrices of 64-bit words."""
    differ = x ^ y
    differ |= differ >> np.uint64(1)
    differ |= differ >> np.uint64(2)
    differ &= np.uint64(0x1111111111111111)
    return CODE - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def _by_code(similarity: float):
    """Of (a, b, na, nb, ca, cb) the pairs whose sketches are to be compared."""
    least = _least_code_matches(similarity)

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            fine = _code_matches(*(_matrix(batch.column(i), np.uint64) for i in (4, 5))) >= least
            fine &= np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(fine))

    return run


def _by_sketch(similarity: float):
    """Of (a, b, sa, sb) the pairs that may be linked."""
    least = _least_matches(similarity)

    def run(batches):
        for batch in batches:
            same = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return run


def _promising(similarity: float):
    """(path, id, cluster) of the documents that may be linked, by their codes, with one
    of another cluster in their list (or in the other list, where ``others`` isn't null)."""
    least = _least_code_matches(similarity)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            between = batch.column(2).null_count == 0
            first, path_a = _flat(batch.column(1), batch.column(0))
            rows = [first, _flat(batch.column(2), batch.column(0))[0]] if between else [first, first]
            (at, _, cluster, n, code), (other_at, _, other_cluster, other_n, other_code) = rows
            size = np.diff(at)
            place = np.repeat(np.arange(len(size)), size)  # of each row its list
            base = other_at[place] if between else at[place]
            count = np.diff(other_at)[place] if between else np.arange(len(place)) - at[place]
            marked = np.zeros(len(place), bool)
            marks = [marked, np.zeros(len(other_n), bool) if between else marked]
            total, a = np.concatenate([[0], np.cumsum(count)]), 0
            while a < len(place):
                b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
                left = np.repeat(np.arange(a, b), count[a:b])
                right = np.arange(total[a], total[b]) - (total[left] - base[left])
                fine = cluster[left] != other_cluster[right]
                fine &= np.minimum(n[left], other_n[right]) >= similarity * np.maximum(n[left], other_n[right]) - 1e-9
                left, right = left[fine], right[fine]
                fine = _code_matches(code[left], other_code[right]) >= least
                marks[0][left[fine]] = True
                marks[1][right[fine]] = True
                a = b
            for (at, ids, cluster, *_), mark in list(zip(rows, marks))[: 1 + between]:
                path = np.repeat(path_a, np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(x[mark]) for x in (path, ids, cluster)], ["path", "id", "cluster"])

    return run


def _flat(lists: pa.ListArray, path: pa.Array) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Where each list begins and ends among all rows, with their columns; and the paths."""
    at = lists.offsets.to_numpy().astype(np.int64)
    values = lists.flatten()
    ids, cluster, n = (values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "cluster", "n"))
    code = _matrix(values.field("bits"), np.uint64)
    return (at - at[0], ids, cluster, n, code), path.to_numpy(zero_copy_only=False)


def _forest(similarity: float):
    """Edges that join, by sketch, clusters in a list of documents (or between two
    lists, where ``others`` isn't null): as few as say what hangs together."""
    least = _least_matches(similarity)

    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for members, others in zip(batch.column(1), batch.column(2)):
                ids, cluster, n, s = _listed(members.values)
                between = others.is_valid
                rows = _listed(others.values) if between else (ids, cluster, n, s)
                root = cluster.copy()
                for i, (doc, own, k, sketch) in enumerate(zip(*rows)):
                    upto = len(ids) if between else i
                    mine = own if between else root[i]
                    at = np.flatnonzero((root[:upto] != mine) & (np.minimum(n[:upto], k) >= similarity * np.maximum(n[:upto], k) - 1e-9))
                    if not len(at):
                        continue
                    at = at[(s[at] == sketch).sum(axis=1) >= least]
                    found, first = np.unique(root[at], return_index=True)
                    for r, f in zip(found.tolist(), first.tolist()):
                        out_a.append(int(ids[at[f]]))
                        out_b.append(int(doc))
                        root[root == r] = mine
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _listed(values: pa.StructArray) -> tuple[np.ndarray, ...]:
    numbers = [values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "cluster", "n")]
    return *numbers, _matrix(values.field("bits"), np.uint8)


def linked_with(queries: list[np.ndarray], sets: list[np.ndarray], share: tuple[int, int]):
    """For each query the places of the sets it is linked with, exactly: an inverted
    index counts its shingles in common with all of them at once."""
    num, den = share
    size = np.array([len(s) for s in sets])
    term, posting = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(term, kind="stable")
    term, posting = term[order], posting[order]
    for q in queries:
        first, last = np.searchsorted(term, q, "left"), np.searchsorted(term, q, "right")
        count = last - first
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        common = np.bincount(posting[at], minlength=len(sets))
        yield np.flatnonzero(den * common >= num * (size + len(q) - common))


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    data, at = textvec.string_bytes(column)
    data = np.frombuffer(data.tobytes(), np.uint64)  # aligned
    return [data[a:b] for a, b in zip((at[:-1] >> 3).tolist(), (at[1:] >> 3).tolist())]


def _decide(share: tuple[int, int]):
    """Streams rows ordered by part (cluster, i, j): emits for each the links of its
    queries that join components, as far as these are known."""

    def work(rows: list[tuple]):
        ids, known, query, sets = zip(*rows)
        _, root = np.unique(known, return_inverse=True)
        asked = [i for i, q in enumerate(query) if q]
        for i, linked in zip(asked, linked_with([sets[i] for i in asked], list(sets), share)):
            found, first = np.unique(root[linked], return_index=True)
            for r, x in zip(found.tolist(), linked[first].tolist()):
                if r != root[i]:
                    yield ids[x], ids[i]
                    root[root == r] = root[i]

    def run(batches):
        part, held = None, []
        for batch in batches:
            links = []
            for *key, doc, known, query, s in zip(*(batch.column(i).to_pylist() for i in range(6)), _sets_of(batch.column(6))):
                if key != part:
                    links += work(held) if len(held) > 1 else ()
                    part, held = key, []
                held.append((doc, known, query, s))
            yield _pairs(links)
        if len(held) > 1:
            yield _pairs(list(work(held)))

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _confirm(share: tuple[int, int]):
    """Of (a, b, sa, sb) the pairs that are linked."""
    num, den = share

    def run(batches):
        for batch in batches:
            fine = []
            for x, y in zip(_sets_of(batch.column(2)), _sets_of(batch.column(3))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return run


def _full_sets(words: int, wanted, segments: int):
    """Sets, with their keys, of the rows whose h the filter may hold."""

    def run(batches):
        hold = membership(wanted.value, segments)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in textvec.chunks(batch.filter(pa.array(hold(h))), "text"):
                sets = shingle_sets(part.column("text"), words)
                key = np.array([_set_key(s) for s in sets]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "k2", "set"])

    return run


def _set_key(s: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)


class _Join:
    """``vertices``: id, n, tokens, sketch, code, a row for each distinct set, deleted
    when the trees are done; ``keys``: id, doc, k1, k2, n of them; ``texts``: id (of a
    document) and text."""

    def __init__(self, texts: DataFrame, vertices: DataFrame, keys: DataFrame, words: int, share: tuple[int, int]):
        self.texts, self.vertices, self.keys, self.words, self.share = texts, vertices, keys, words, share
        self.similarity = share[0] / share[1]
        self.spent: list[DataFrame] = []  # tables that only the edges in hand read
        self.near = vertices  # those that the nodes in hand may have
        self.edges: list[DataFrame] = []  # what may hang together
        self.cluster: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        """Takes more edges, and brings the clusters up to date with them alone."""
        edges = materialise(edges.distinct(), "candidates")
        self.edges.append(edges)
        discard(*self.spent)
        self.spent = []
        ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        if self.cluster is None:
            self.cluster = connected_components(edges)
            return
        known = self.cluster.withColumnRenamed("component", "cluster")
        between = edges
        for end in ("a", "b"):
            between = between.join(known.withColumnsRenamed({"id": end, "cluster": f"c{end}"}), end, "left")
        between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        merged = connected_components(materialise(between, "between"))
        every = known.unionByName(ends.join(known, "id", "left_anti").withColumn("cluster", F.col("id")))
        every = every.join(merged.withColumnRenamed("id", "cluster"), "cluster", "left").select("id", F.coalesce("component", "cluster").alias("component"))
        before, self.cluster = self.cluster, materialise(every, "clusters")
        discard(before, merged)

    def among(self, rows: DataFrame) -> DataFrame:
        """The vertices that ``rows`` has, and a few others: joins needn't shuffle the rest."""
        packed, segments = value_filter(rows.select(F.xxhash64("id").alias("h")), rows.count(), least=1)
        maybe = may_hold(rows.sparkSession.sparkContext.broadcast(packed), segments)
        return self.vertices.where(maybe(F.xxhash64("id")))

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.cluster is None:
            return rows.withColumn("cluster", F.col("id"))
        known = self.cluster.withColumnRenamed("component", "cluster")
        return rows.join(known, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))

    def compared(self, nodes: DataFrame, main: DataFrame | None = None) -> DataFrame:
        """Edges of nodes that end here: small ones in themselves, large ones (those in
        ``main``: path, main, size) between the documents outside their main cluster and
        all others."""
        nodes = nodes.select("path", "id", "cluster")
        lists = self.lists(nodes, main, self.near.select("id", "n", F.col("code").alias("bits")))
        found = lists.mapInArrow(textvec.releasing(_promising(self.similarity)), "path long, id long, cluster long")
        found = materialise(found if main is None else found.distinct(), "promising")
        self.spent.append(found)
        release_shuffles(found.sparkSession)
        lists = self.lists(found, main, self.among(found).select("id", "n", F.col("sketch").alias("bits")))
        return lists.mapInArrow(textvec.releasing(_forest(self.similarity)), "a long, b long")

    def lists(self, nodes: DataFrame, main: DataFrame | None, bits: DataFrame) -> DataFrame:
        """(path, members, others), in blocks of members where there are others."""
        member = F.collect_list(F.struct("id", "cluster", "n", "bits"))
        nodes = nodes.join(bits, "id")
        if main is None:
            lists = nodes.groupBy("path").agg(member.alias("members"))
            return lists.select("path", "members", F.lit(None).cast(lists.schema["members"].dataType).alias("others"))
        nodes = nodes.join(main.select("path", "main", "size"), "path")
        outside = nodes.where("cluster <> main").groupBy("path").agg(member.alias("others"))
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
        blocks = nodes.groupBy("path", block.alias("block")).agg(member.alias("members"))
        return blocks.join(outside, "path").select("path", "members", "others")

    def starred(self, star: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that may be linked."""
        codes = self.near.select("id", "n", "code")
        for end in ("a", "b"):
            star = star.join(codes.withColumnsRenamed({"id": end, "n": f"n{end}", "code": f"c{end}"}), end)
        star = star.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(textvec.releasing(_by_code(self.similarity)), "a long, b long")
        star = materialise(star, "promising-pairs")
        self.spent.append(star)
        release_shuffles(star.sparkSession)
        sketches = self.among(star.select(F.explode(F.array("a", "b")).alias("id"))).select("id", "sketch")
        for end in ("a", "b"):
            star = star.join(sketches.withColumnsRenamed({"id": end, "sketch": f"s{end}"}), end)
        return star.select("a", "b", "sa", "sb").mapInArrow(textvec.releasing(_by_sketch(self.similarity)), "a long, b long")

    def level(self, nodes: DataFrame) -> DataFrame | None:
        """Takes edges from one level of the trees; returns the nodes below it."""
        shared = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.xxhash64("id")).alias("leader"))
        shared = materialise(shared.where("size > 1"), "shared-nodes")  # both sides of the join are plain exchanges then
        nodes = materialise(nodes.join(shared, "path"), "nodes")
        release_shuffles(nodes.sparkSession)
        small = nodes.where(F.col("size") <= SMALL).select("path", "id")
        if self.cluster is None:  # what a part of the trees' nodes finds together has no need of its sketches in the rest
            part = F.pmod("path", F.lit(4)) == 0
            self.add(self.compared(self.labelled(small.where(part))))
            small = small.where(~part)
        star = nodes.where((F.col("size") > SMALL) & (F.col("id") != F.col("leader")))
        star = star.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
        self.add(self.compared(self.labelled(small)).unionByName(self.starred(star)))

        large = nodes.where(F.col("size") > SMALL).select("path", "id", "size")
        if large.isEmpty():
            discard(shared, nodes)
            return None
        large = materialise(self.labelled(large), "large-nodes")
        release_shuffles(large.sparkSession)
        parts = large.groupBy("path", "size", "cluster").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.groupBy("path", "size").agg(F.max("n").alias("most"), F.max_by("cluster", "n").alias("main"))
        parts = parts.where("most < size").select("path", "main", "size", (F.col("size") - F.col("most")).alias("outside"))
        parts = materialise(parts, "parts")
        open_ = materialise(large.drop("size").join(parts, "path"), "open-nodes")
        self.near = self.among(open_)
        ends = F.col("outside") <= OUTSIDE
        self.add(self.compared(open_.where(ends), parts.where(ends)))
        below = open_.where(~ends).join(self.near.select("id", "tokens"), "id").select("path", "id", "tokens")
        below = materialise(below.mapInArrow(textvec.releasing(_branch), "path long, id long"), "branches")
        discard(shared, nodes, large, parts, open_)
        return below

    def run(self) -> DataFrame:
        """(id, component) of all vertices that have an exact link."""
        nodes = self.level(self.vertices.select("id", "tokens").mapInArrow(textvec.releasing(_roots), "path long, id long"))
        while nodes is not None and not nodes.isEmpty():
            nodes = self.level(nodes)
        discard(self.vertices)  # tokens and sketches have done their work
        clusters = self.cluster.withColumnRenamed("component", "cluster")
        placed = clusters.join(self.keys.select("id", "n"), "id")
        sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
        one = (F.col("docs") <= TOGETHER) & (F.col("shingles") <= SHINGLES)
        blocks = F.when(one, 1).otherwise(1 + F.greatest(F.ceil(2 * F.col("docs") / TOGETHER), F.ceil(2 * F.col("shingles") / SHINGLES)))
        sizes = materialise(sizes.select("cluster", blocks.cast("int").alias("blocks")), "cluster-sizes")
        placed = materialise(clusters.join(sizes, "cluster"), "placed")
        sets = self.full_sets(placed)
        one = F.col("blocks") == 1
        zero = F.lit(0).cast("int")
        columns = ["cluster", "i", "j", "id", "known", "query", "set"]
        rows = sets.where(one).select("cluster", zero.alias("i"), zero.alias("j"), "id", F.col("id").alias("known"), F.lit(True).alias("query"), "set")
        several = placed.where(~one)
        confirmed = None
        if not several.isEmpty():
            large = sets.where(~one).select("id", "set")
            confirmed = self.confirmed(several.select("id"), large)
            rows = rows.unionByName(self.blocks(several, confirmed).join(large, "id").select(*columns))
        rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        links = rows.mapInArrow(textvec.releasing(_decide(self.share)), "a long, b long")
        links = materialise(links if confirmed is None else links.unionByName(confirmed), "links")
        discard(sets, placed, sizes, *self.edges)
        return connected_components(links)

    def full_sets(self, placed: DataFrame) -> DataFrame:
        """(id, cluster, blocks, set) of the placed vertices, read from the texts again
        and shuffled once."""
        spark = placed.sparkSession
        wanted = materialise(placed.join(self.keys.select("id", "doc", "k1", "k2"), "id"), "wanted")
        packed, segments = value_filter(wanted.select(F.xxhash64("doc").alias("h")), wanted.count(), least=1)
        needed = spark.sparkContext.broadcast(packed)
        texts = self.texts.where("id is not null").select(F.xxhash64("id").alias("h"), "text")
        sets = texts.mapInArrow(textvec.releasing(_full_sets(self.words, needed, segments)), "k1 long, k2 long, set binary")
        sets = sets.join(wanted.drop("doc"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # a key has one id
        out = materialise(sets.select("id", "cluster", "blocks", "set"), "sets")
        discard(wanted)
        return out

    def confirmed(self, vertices: DataFrame, sets: DataFrame) -> DataFrame:
        """Of the edges between each vertex and its smallest neighbour those that are links."""
        edges = None
        for e in self.edges:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            edges = both if edges is None else edges.unionByName(both)
        edges = edges.groupBy("a").agg(F.min("b").alias("b")).join(vertices.withColumnRenamed("id", "a"), "a")
        edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "to-confirm")
        for end in ("a", "b"):
            edges = edges.join(sets.withColumnsRenamed({"id": end, "set": f"s{end}"}), end)
        return materialise(edges.select("a", "b", "sa", "sb").mapInArrow(textvec.releasing(_confirm(self.share)), "a long, b long"), "confirmed")

    def blocks(self, several: DataFrame, confirmed: DataFrame) -> DataFrame:
        """Rows for ``_decide``: every block of a large cluster with every chunk of its
        open vertices, those outside its largest confirmed component."""
        known = connected_components(confirmed).withColumnRenamed("component", "known")
        rows = several.join(known, "id", "left").withColumn("known", F.coalesce("known", "id"))
        rows = materialise(rows, "known")
        parts = rows.groupBy("cluster", "known").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.groupBy("cluster").agg(F.max_by("known", F.struct("n", "known")).alias("main"), (F.sum("n") - F.max("n")).alias("open"), F.sum("n").alias("docs"))
        chunks = F.ceil(F.col("open") * F.lit(1.0) / F.col("docs") * F.col("blocks")).cast("int")
        rows = rows.join(materialise(parts.where("open > 0"), "open-clusters"), "cluster").withColumn("chunks", F.greatest(chunks, F.lit(1)))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = rows.select("cluster", own("blocks").alias("i"), all_("chunks").alias("j"), "id", "known", F.lit(False).alias("query"))
        chunk = rows.where("known <> main").select("cluster", all_("blocks").alias("i"), own("chunks").alias("j"), "id", "known", F.lit(True).alias("query"))
        return materialise(block.unionByName(chunk), "block-rows")


def _vertices(linked: DataFrame) -> DataFrame:
    """A row for each distinct set. Tokens are shuffled once, and of copies those of one a task."""
    sets = linked.groupBy("k1", "k2").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sketch = F.concat(*(F.substring("tokens", 4 * i + 1, 1) for i in range(COORDINATES)))
    return sets.select(F.monotonically_increasing_id().alias("id"), "doc", "k1", "k2", "n", "tokens", sketch.alias("sketch"))


def near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 5, share: tuple[int, int] = (4, 5),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows are linked when their shingle sets have a Jaccard similarity of ``share``
    or more; ``component_id`` is the smallest id reachable, and that document
    stays. ``doc_id`` must be an integer column. A null or wordless text has an
    empty set and is linked with nothing; so is a row with a null id (its component
    is null, and it stays). Rows that repeat an id are rows of their own: sharing
    an id links nothing, and each is judged by its own text. Other columns are
    ignored; an empty table gives no rows.
    """
    session(docs)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = materialise(texts.mapInArrow(textvec.releasing(_embed(words)), "id long, n long, k1 long, k2 long, tokens binary"), "sets")
    linked = sets.where("id is not null and n > 0")
    # with a number for each distinct set, fixed by being written
    vertices = materialise(_vertices(linked).withColumn("code", _code("sketch")), "vertices")
    release_shuffles(vertices.sparkSession)
    keys = materialise(vertices.select("id", "doc", "k1", "k2", "n"), "keys")
    groups = keys.select("k1", "k2", F.col("doc").alias("first"), F.col("id").alias("v"))
    members = materialise(linked.select("id", "n", "k1", "k2").join(groups, ["k1", "k2"]).select("id", "n", "first", "v"), "members")
    alone = materialise(sets.where("id is null or n = 0").select("id", "n", F.col("id").alias("component")), "alone")
    discard(sets)
    parts = _Join(texts, vertices, keys, words, share).run().withColumnsRenamed({"id": "v", "component": "part"})
    smallest = groups.select("v", "first").join(parts, "v")
    smallest = smallest.join(smallest.groupBy("part").agg(F.min("first").alias("component")), "part").select("v", "component")
    smallest = materialise(smallest, "smallest")
    discard(keys)
    out = members.join(smallest, "v", "left").select("id", "n", F.coalesce("component", "first").alias("component"))
    out = out.unionByName(alone)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )
