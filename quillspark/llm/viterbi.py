"""SentencePiece encoding by streaming Viterbi, and decoding.

``StreamingViterbi`` reads texts a block of letters at a time and keeps scores of
the last ``longest`` positions only (no vocabulary piece is longer), with the
backpointers of what isn't committed yet. After each block it walks back from
all positions that a later piece can still start at; where these paths meet in
one boundary, the ids up to it are committed and their backpointers go. Of
equal segmentations the one with the longer last piece wins, so the result
doesn't depend on how a text was cut into blocks. Scores of a BPE model are exact
integers. Those of a unigram model are summed as the library does it, in float32 from
the start of each text, as its rounding decides between segmentations that have the
same pieces in another order.

Many texts run side by side, one a *lane*, so that a step over all lanes is one
array operation. A boundary that no piece of the vocabulary can cross (before a
blank that follows a non-blank, beside a line end) is one where all paths meet
whatever surrounds it; long texts go on in the next lane there, but for unigram
models, whose sums depend on all that came before.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import session
from .tokens import HashTable

BLANK = "▁"
#: Below the lowest piece score: what a letter costs that is no piece and goes by its bytes.
UNKNOWN_PENALTY = 10.0
#: Letters of a block in each lane; lanes at most; letters in a lane at least, where texts allow.
BLOCK, LANES, LANE_LETTERS = 128, 1024, 512
#: What stands for ids of letters that go by their bytes, and of ends of texts.
BY_BYTES, END = -2, -3
#: Scores are integers, so that sums are exact: SCALE to one, with LENGTH_BITS below for the length of the last piece,
#: which decides between equals.
SCALE, LENGTH_BITS = 1 << 22, 8
_NO = np.int64(-(1 << 60))


class Vocabulary:
    """Pieces and scores of a model file; pieces as a trie in a hash table.

    Scores of a BPE model are ranks (0, -1, -2, ...), not logarithms of
    frequencies. Such ranks are read by Zipf's law: -log(1 + rank). ``exact`` says
    that scores are integers, as they are then.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of = [b""] * n
        pieces, scores = {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece], scores[piece] = i, sp.get_score(i)
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
        self.exact = all(s <= 0 and s == int(s) for s in scores.values())
        if self.exact:
            scores = {p: -float(np.log1p(-s)) for p, s in scores.items()}
            unknown = min(scores.values()) - UNKNOWN_PENALTY
            scores = {p: round(s * SCALE) << LENGTH_BITS for p, s in scores.items()}
            self.unknown = round(unknown * SCALE) << LENGTH_BITS
        else:
            self.unknown = np.float32(min(scores.values())) - np.float32(UNKNOWN_PENALTY)
        self.score_type, self.no = (np.int64, _NO) if self.exact else (np.float32, np.float32(-np.inf))
        self.longest = max(map(len, pieces))
        if self.longest >> LENGTH_BITS:
            raise ValueError(f"a piece has {self.longest} letters, more than {(1 << LENGTH_BITS) - 1}")
        inner = re.compile(f"[^{BLANK}]{BLANK}|\n")
        self.splits = not any(inner.search(p) for p in pieces)
        self._build(pieces, scores)

    def _build(self, pieces: dict[str, int], scores: dict[str, float]) -> None:
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110000, np.uint16)  # 0: in no piece
        for i, c in enumerate(letters):
            self.letter[ord(c)] = i + 1
        self.blank = int(self.letter[ord(BLANK)])
        self.letter[ord(" ")], self.letter[ord(BLANK)] = self.blank, 0  # a text's own BLANK goes by its bytes
        width = self.width = len(letters) + 1
        nodes: dict[int, int] = {}  # (parent, letter) to node; 0 is the root
        of_letter = {c: i + 1 for i, c in enumerate(letters)}
        piece_at, score_at = [-1], [0]
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                key = node * width + of_letter[c]
                node = nodes.get(key)
                if node is None:
                    node = nodes[key] = len(piece_at)
                    piece_at.append(-1)
                    score_at.append(0)
            piece_at[node], score_at[node] = number, scores[piece]
        self.piece_at, self.score_at = np.array(piece_at, np.int32), np.array(score_at, self.score_type)
        keys, values = np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32)
        self.first = np.full(width, -1, np.int32)  # the root's children
        self.first[keys[keys < width]] = values[keys < width]
        self.single = np.zeros(width, bool)  # letters that are pieces
        self.single[1:] = self.piece_at[np.maximum(self.first[1:], 0)] >= 0
        self.single[1:] &= self.first[1:] >= 0
        self.table = HashTable(max(16, int(len(keys)).bit_length() + 3))
        self.table.add(self._hash(keys), values)

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        # an odd factor loses nothing, so the table compares whole keys
        return (keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes below, -1 where there are none."""
        return self.table.find(self._hash(node.astype(np.int64) * self.width + letter))


class StreamingViterbi:
    """Segments ``lanes`` streams at once. ``feed`` takes the next letters of each (a
    matrix, one column a lane, 0 where nothing is known) and returns what is certain
    now: lanes, positions where a piece ends, and ids (BY_BYTES for an unknown letter)."""

    def __init__(self, vocabulary: Vocabulary, lanes: int):
        self.v, self.lanes = vocabulary, lanes
        longest = vocabulary.longest
        self.unread = np.zeros((0, lanes), np.uint16)  # letters whose longest piece may end beyond what is in sight
        self.best = np.full((longest, lanes), vocabulary.no)  # scores of the last positions, the newest last
        self.best[-1] = 0
        # by (place, longest - length, lane) the pieces that end there; the first ``longest`` places hold those found before
        self.ends = np.full((longest, longest, lanes), vocabulary.no)
        self.ids_ahead = np.zeros((longest, longest, lanes), np.int32)
        self.lengths = np.zeros((1, lanes), np.uint8)  # of the best piece that ends at each position from ``base`` on
        self.ids = np.zeros((1, lanes), np.int32)
        self.base = 0  # the position of the first row of ``lengths``
        self.committed = np.zeros(lanes, np.int64)
        self.position = 0
        self.commits = self.widest = 0

    def feed(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.unread = np.concatenate([self.unread, letters])
        steps = len(self.unread) - self.v.longest + 1
        if steps <= 0:
            return self._nothing()
        self._advance(steps)
        return self._commit(self._meeting())

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rest. All paths end where the letters do."""
        steps = len(self.unread)
        self.unread = np.concatenate([self.unread, np.zeros((self.v.longest, self.lanes), np.uint16)])
        if steps:
            self._advance(steps)
        return self._commit(np.full(self.lanes, self.position))

    @staticmethod
    def _nothing():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _advance(self, steps: int) -> None:
        """Extends all paths by ``steps`` letters."""
        v, lanes, longest = self.v, self.lanes, self.v.longest
        if len(self.ends) < steps + longest:  # kept for the next block
            self.ends = np.concatenate([self.ends, np.full((steps + longest - len(self.ends), longest, lanes), v.no)])
            self.ids_ahead = np.concatenate([self.ids_ahead, np.zeros((steps + longest - len(self.ids_ahead), longest, lanes), np.int32)])
        ends, ids, letters = self.ends.reshape(-1), self.ids_ahead.reshape(-1), self.unread.reshape(-1)
        stride = longest * lanes

        def found(start: np.ndarray, length: int, score, number) -> None:
            row = start // lanes
            to = start + row * (stride - lanes) + ((length - 1) * stride + (longest - length) * lanes)
            ends[to] = score + length if v.exact else score
            ids[to] = number

        here = letters[: steps * lanes]
        found(np.flatnonzero(~v.single[here]), 1, v.unknown, BY_BYTES)
        node = v.first[here]
        at = np.flatnonzero(node >= 0)
        node = node[at]
        for length in range(1, longest + 1):  # pieces of this length from each start
            piece = v.piece_at[node]
            done = np.flatnonzero(piece >= 0)
            found(at[done], length, v.score_at[node[done]], piece[done])
            if length == longest:
                break
            node = v.child(node, letters[at + length * lanes])
            some = np.flatnonzero(node >= 0)
            at, node = at[some], node[some]
        best = np.empty((longest + steps, lanes), v.score_type)
        best[:longest] = self.best
        lengths = np.empty((steps, lanes), np.int64)
        paths, mask = np.empty((longest, lanes), v.score_type), np.int64((1 << LENGTH_BITS) - 1)
        for j in range(steps):
            np.add(best[j:j + longest], self.ends[j], out=paths)
            if v.exact:
                np.maximum.reduce(paths, axis=0, out=lengths[j])
                np.bitwise_and(lengths[j], ~mask, out=best[j + longest])
            else:
                np.argmax(paths, axis=0, out=lengths[j])  # the first, so the longest, of equals
                np.maximum.reduce(paths, axis=0, out=best[j + longest])
        lengths = lengths & mask if v.exact else longest - lengths
        place = (np.arange(steps)[:, None] * longest + longest - lengths) * lanes + np.arange(lanes)
        chosen = ids[place]
        self.best = best[-longest:]
        if v.exact:
            self.best = self.best - self.best.max(axis=0)  # only differences matter
            self.best[self.best < _NO // 2] = _NO
        self.ends[:longest], self.ids_ahead[:longest] = self.ends[steps:steps + longest], self.ids_ahead[steps:steps + longest]
        self.ends[longest:] = v.no
        self.unread = self.unread[steps:]
        self.lengths, self.ids = np.concatenate([self.lengths, lengths.astype(np.uint8)]), np.concatenate([self.ids, chosen])
        self.position += steps
        self.widest = max(self.widest, len(self.lengths) - 1)

    def _meeting(self) -> np.ndarray:
        """Walks back from every position a later piece can start at until the paths
        of a lane stand at one boundary, or have passed all that isn't committed."""
        lane = np.arange(self.lanes)
        live = np.maximum(np.arange(self.position - self.v.longest + 1, self.position + 1)[:, None], self.committed)
        while True:
            last = live.max(axis=0)
            open_ = (live != last).any(axis=0) & (last > self.committed)
            if not open_.any():
                return np.where((live == last).all(axis=0), last, self.committed)
            back = last - self.lengths[np.maximum(last - self.base, 0), lane]
            live = np.where((live == last) & open_, np.maximum(back, self.committed), live)

    def _commit(self, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lanes, positions, ids = [], [], []
        lane = np.flatnonzero(upto > self.committed)
        self.commits += len(lane)
        at = upto[lane]
        while len(lane):
            row = at - self.base
            lanes.append(lane)
            positions.append(at)
            ids.append(self.ids[row, lane])
            at = at - self.lengths[row, lane]
            more = at > self.committed[lane]
            lane, at = lane[more], at[more]
        self.committed = np.maximum(upto, self.committed)
        base = int(self.committed.min())
        self.lengths, self.ids = self.lengths[base - self.base:], self.ids[base - self.base:]
        self.base = base
        return (np.concatenate(lanes), np.concatenate(positions), np.concatenate(ids)) if lanes else self._nothing()


class PieceEncoder:
    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.commits = self.widest = 0  # of all streams so far

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. One blank is put before a text that isn't empty."""
        if not texts:
            return []
        v = self.v
        given = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(t + "\0" for t in given).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in given], np.int64)
        ends = np.cumsum(sizes) - 1  # the place after each text, which no piece crosses
        letters = v.letter[code]
        letters[ends] = 0
        starts = self._lane_starts(letters, code, ends)
        lengths = np.diff(np.append(starts, len(code)))
        ids = np.full(len(code), -1, np.int32)  # at the last letter of each piece
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(starts), LANES):  # lanes of about the same length run together
            self._run(letters, starts[order[a:a + LANES]], lengths[order[a:a + LANES]], ids)
        ids[ends] = END
        return self._listed(ids, code, ends)

    def _lane_starts(self, letters: np.ndarray, code: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of texts, and boundaries inside them that no piece crosses, so far
        apart that lanes get ``LANE_LETTERS`` or more; for unigram models all starts of texts."""
        if not self.v.exact:
            return np.append(0, ends[:-1] + 1)
        fence = np.zeros(len(code), bool)
        fence[0] = True
        fence[ends[:-1] + 1] = True
        if self.v.splits:
            blank = letters == self.v.blank
            fence[1:] |= blank[1:] & ~blank[:-1]
        fences = np.flatnonzero(fence)
        each = max(LANE_LETTERS, -(-len(code) // LANES))
        return fences[np.unique(fences // each, return_index=True)[1]]

    def _run(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        stream, width = StreamingViterbi(self.v, len(starts)), int(lengths.max())
        for at in range(0, width + BLOCK, BLOCK):
            if at < width:
                column = np.arange(at, min(at + BLOCK, width))[:, None]
                block = np.where(column < lengths, letters[np.minimum(starts + column, len(letters) - 1)], 0)
                lane, position, found = stream.feed(block.astype(np.uint16))
            else:
                lane, position, found = stream.finish()
            fine = position <= lengths[lane]
            ids[starts[lane[fine]] + position[fine] - 1] = found[fine]
        self.commits += stream.commits
        self.widest = max(self.widest, stream.widest)

    def _listed(self, ids: np.ndarray, code: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        by_bytes = np.flatnonzero(ids == BY_BYTES)
        own = [chr(c).encode("utf-8", "surrogatepass") for c in code[by_bytes].tolist()]
        times = (ids != -1).astype(np.int64)
        times[ends] = 0
        times[by_bytes] = list(map(len, own))
        total = np.concatenate([[0], np.cumsum(times)])
        flat = np.repeat(ids, times)
        if own:
            places = np.concatenate([np.arange(total[i], total[i + 1]) for i in by_bytes.tolist()])
            flat[places] = self.v.byte_ids[np.frombuffer(b"".join(own), np.uint8)]
        return np.split(flat, total[ends[:-1]])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(model_file: str) -> PieceEncoder:
    if model_file not in _ENCODERS:
        _ENCODERS.clear()  # one model at a time in a worker
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text as little-endian uint32 (binary).

    A null or empty text has no ids. Blanks and line ends are kept, so ``decode``
    gives every text back exactly. Null and repeated ids don't matter; other
    columns pass through, one called ``name`` is replaced, and an empty table
    gives an empty result.
    """
    session(docs)

    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        enc, out = piece_encoder(model_file), []
        for part in textvec.chunks(pa.RecordBatch.from_arrays([column], ["t"]), "t", 1 << 20):
            out += [x.astype("<u4").tobytes() for x in enc.encode([t or "" for t in part.column(0).to_pylist()])]
        return pa.array(out, pa.binary())

    return docs.withColumn(name, run(F.col(text)))


_READ = T.StructType([T.StructField("n_ids", T.LongType()), T.StructField("crc32", T.LongType()), T.StructField("text", T.StringType())])


def read_back(ids: Column, model_file: str) -> Column:
    """Of encoded ids a struct: how many, their CRC-32, and the text they stand for."""

    @F.arrow_udf(_READ)
    def run(column: pa.Array) -> pa.Array:
        enc = piece_encoder(model_file)
        raw = [x.as_py() or b"" for x in column]
        columns = [
            pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
            pa.array([enc.decode(np.frombuffer(x, "<u4")) for x in raw], pa.string()),
        ]
        return pa.StructArray.from_arrays(columns, ["n_ids", "crc32", "text"])

    return run(ids)
