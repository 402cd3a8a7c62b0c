"""Byte-level BPE ids of whole texts, a batch of texts at a time.

Most of a batch's time in a BPE library goes into words that come again and
again. Here the batch is cut into pre-tokens with numpy, each distinct pre-token
is encoded once by the tokenizer's own merges, and the ids are gathered. A
pre-token is found by a 64-bit hash and then compared letter by letter. Texts
that the cutting rules below don't cover (letters beyond Latin, contractions)
go through the library whole, so the ids are always those of the tokenizer.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain

import numpy as np

from .textvec import mixed, powers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: Code points below this one are classed by a table; Unicode has been stable there for decades.
FIRST_UNCOVERED = 0x370
#: Distinct pre-tokens remembered across batches.
REMEMBERED = 300_000


def _classes() -> np.ndarray:
    out = np.zeros(FIRST_UNCOVERED, np.uint8)
    for c in range(FIRST_UNCOVERED):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    out[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0]] = SPACE
    return out


def _extended(flat: np.ndarray, at: np.ndarray, n: int, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n lists one after another (``at``: where each starts), and more of them."""
    used, total = int(at[n]), int(sizes.sum())
    while len(flat) < used + total:
        flat = np.concatenate([flat, np.zeros_like(flat)])
    while len(at) < n + len(sizes) + 1:
        at = np.concatenate([at, np.zeros_like(at)])
    flat[used:used + total] = values
    at[n + 1:n + 1 + len(sizes)] = used + np.cumsum(sizes)
    return flat, at


class HashTable:
    """64-bit keys to numbers by open addressing, looked up a whole array at a time."""

    def __init__(self, bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)  # 0: free
        self.values = np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't there."""
        slot = (h >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            key = self.keys[slot[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        slot, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]  # of several that want a slot the last gets it
            won = free[self.keys[slot[free]] == h[free]]
            self.values[slot[won]] = values[won]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = slot[todo] + 1 & self.mask


class BatchEncoder:
    """``encode(texts)`` gives (flat ids as uint32, offsets of the texts in them)."""

    def __init__(self, tokenizer_json: str, ranks_file: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_json)
        self.whole.encode_special_tokens = True  # their strings inside a text are ordinary text
        self.single = self._pieces(ranks_file) if ranks_file else self._pieces_of_library
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        self.known, self.count_known = HashTable(), 0
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)  # ids of what is known
        self.letters, self.letters_at = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64)  # and its letters

    @staticmethod
    def _pieces(ranks_file: str):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("quillspark", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def _pieces_of_library(self, piece: bytes) -> list[int]:
        return self.whole.encode(piece.decode(), add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        n = self.count_known
        text, lens = cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), end - start
        ids = [self.single(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(start.tolist(), end.tolist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat, self.at = _extended(self.flat, self.at, n, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))
        places = np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        self.letters, self.letters_at = _extended(self.letters, self.letters_at, n, lens, cp[places])
        self.known.add(hashes, np.arange(n, n + len(ids), dtype=np.int32))
        self.count_known += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cp, bounds, odd = self._points(texts)
        if odd is not None:
            return self._split(texts, odd)
        which, token, known = self._known(cp, bounds)
        if not known:
            return self._split(texts, np.ones(len(texts), bool))
        lens = self.at[which + 1] - self.at[which]
        ends = np.cumsum(lens)
        gather = np.repeat(self.at[which] - ends + lens, lens)
        gather += np.arange(len(gather))
        return self.flat[gather], np.concatenate([[0], ends])[token]

    def count(self, texts: list[str]) -> int:
        """How many ids ``encode`` would give."""
        cp, bounds, odd = self._points(texts)
        if odd is not None:
            return len(self._split(texts, odd)[0])
        which, _, known = self._known(cp, bounds)
        return int((self.at[which + 1] - self.at[which]).sum()) if known else len(self._split(texts, np.ones(len(texts), bool))[0])

    def _points(self, texts: list[str]):
        """The texts' code points, their bounds, and which texts the cutting rules
        don't cover (None: they cover all)."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        odd = cp >= FIRST_UNCOVERED
        quote = np.flatnonzero(cp == 0x27)
        if len(quote):  # 's, 't, 're, 've, 'm, 'll, 'd may be pre-tokens of their own
            nxt = cp[np.minimum(quote + 1, len(cp) - 1)]
            odd[quote[np.isin(nxt, np.frombuffer("stmdrlv".encode("utf-32-le"), np.uint32))]] = True
        if not odd.any():
            return cp, bounds, None
        return cp, bounds, np.add.reduceat(np.append(odd, False), bounds[:-1]) * (np.diff(bounds) > 0) > 0

    def _known(self, cp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The number of each pre-token among those known (all are, afterwards), the
        first pre-token of each text, and whether all letters are those of the known
        ones (two pre-tokens of one hash would differ here)."""
        if self.count_known > REMEMBERED:
            self.clear()
        start = self._starts(cp, bounds)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), True
        end = np.append(start[1:], len(cp))
        prefix = np.zeros(len(cp) + 1, np.uint64)
        np.multiply(cp, np.uint64(0xD1342543DE82EF95), out=prefix[1:])
        prefix[1:] += np.uint64(0x632BE59BD9B4E019)
        prefix[1:] *= powers("up", len(cp))
        np.cumsum(prefix, out=prefix)
        h = prefix[end]
        h -= prefix[start]
        h *= powers("down", len(prefix))[start]
        h += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h = np.maximum(mixed(h), np.uint64(1))
        which = self.known.find(h)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            distinct, first = np.unique(h[missing], return_index=True)
            first = missing[first]
            self._learn(distinct, cp, start[first], end[first])
            which[missing] = self.known.find(h[missing])
        size = np.diff(start, append=len(cp))
        places = np.repeat(self.letters_at[which] - start, size)
        places += np.arange(len(cp))
        known = bool((self.letters_at[which + 1] - self.letters_at[which] == size).all()) and bool((self.letters[places] == cp).all())
        return which, np.searchsorted(start, bounds), known

    def _starts(self, cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of letters, numbers or other characters,
        each with a blank before it; of white space before a run all but the last."""
        if not len(cp):
            return np.zeros(0, np.int64)
        kind = self.classes[cp]
        first = np.zeros(len(cp) + 1, bool)
        first[bounds] = True
        run = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]) | first[:-1])
        stop = np.append(run[1:], len(cp))
        white = kind[run] == SPACE
        mark = np.zeros(len(cp), bool)
        word = run[~white]
        blank = (word > 0) & (cp[np.maximum(word, 1) - 1] == 0x20) & ~first[word]
        mark[word - blank] = True
        mark[run[white]] = True
        mark[stop[white & ~first[stop]] - 1] = True
        return np.flatnonzero(mark)

    def _split(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = [t for t, x in zip(texts, odd) if not x]
        flat, at = self.encode(plain)
        ids = iter([flat[a:b] for a, b in zip(at[:-1], at[1:])])
        parts = [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if x else next(ids)
            for t, x in zip(texts, odd)
        ]
        out = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=out[1:])
        return np.concatenate(parts), out


_ENCODERS: dict[tuple, BatchEncoder] = {}


def encoder(tokenizer_json: str, ranks_file: str | None = None) -> BatchEncoder:
    """One encoder for each worker process."""
    key = (tokenizer_json, ranks_file)
    if key not in _ENCODERS:
        _ENCODERS.clear()  # one at a time in a worker
        _ENCODERS[key] = BatchEncoder(*key)
    return _ENCODERS[key]
