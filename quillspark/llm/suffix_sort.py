"""Deep-shallow sorting of many suffixes of bounded depth at once.

Suffixes come as rows of a byte matrix: symbols are bytes + 1 (UTF-8 has no
0xFF), and 0 fills what lies beyond a suffix's end. Rows are first ordered by
multikey quicksort to ``SHALLOW`` symbols; whatever still ties there shares a
long prefix, and each such group goes into a blind trie, whose in-order walk
gives the rest of the order.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def suffix_order(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Permutation that sorts ``rows`` by (group, symbols)."""
    order, start = multikey_quicksort(rows, group)
    bounds = np.flatnonzero(np.append(start, True))
    for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
        a, b = int(bounds[i]), int(bounds[i + 1])
        deep = order[a:b]
        order[a:b] = deep[_trie_order([rows[i].tobytes() for i in deep])]
    return order


def multikey_quicksort(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` by (group, first ``SHALLOW`` symbols), and where in it each
    block of rows that still tie starts.

    Every block has a pivot, the key of its middle row at the block's depth, and
    falls into the rows below, at and above it; only those at the pivot go one key
    deeper. A key is eight symbols. All blocks of a round are split together.
    """
    n, depth = rows.shape
    keys = min(SHALLOW, depth + 7 & ~7) // 8
    head = np.zeros((n, keys * 8), np.uint8)
    head[:, : min(depth, keys * 8)] = rows[:, : keys * 8]
    head = head.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    start = np.concatenate([np.ones(min(1, n), bool), group[order][1:] != group[order][:-1]])
    deep = np.zeros(n, np.int64)  # of the row at each place
    while True:
        alone = start & np.append(start[1:], True)
        open_ = np.flatnonzero(~alone & (deep < keys))
        if not len(open_):
            return order, start
        rows_here, first = order[open_], start[open_]
        block = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        middle = begin + np.diff(np.append(begin, len(open_))) // 2
        key = head[rows_here, deep[open_]]
        pivot = key[middle][block]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        part = block * 3 + side
        by = np.argsort(part, kind="stable")
        order[open_] = rows_here[by]
        deep[open_] = deep[open_][by] + (side[by] == 1)
        start[open_] |= np.concatenate([[True], part[by][1:] != part[by][:-1]])


def _mismatch(a: bytes, b: bytes) -> int:
    """First place where two different strings of equal length differ."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (x.bit_length() + 7 >> 3)


def _trie_order(strings: list[bytes]) -> list[int]:
    """Sorted order of strings of equal length through a blind trie.

    An inner node is [depth, {symbol: child}], a leaf (string, [places]). A
    string walks down by the symbols at branching depths only, compares itself
    with the one leaf it ends at, and branches off where they differ.
    """
    if len(strings) == 2:
        return [0, 1] if strings[0] <= strings[1] else [1, 0]
    root = (strings[0], [0])
    for place in range(1, len(strings)):
        s = strings[place]
        node = root
        while type(node) is list:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        if node[0] == s:
            node[1].append(place)
            continue
        depth = _mismatch(node[0], s)
        parent, node_here = None, root
        while type(node_here) is list and node_here[0] < depth:
            parent, node_here = node_here, node_here[1][s[node_here[0]]]
        leaf = (s, [place])
        if type(node_here) is list and node_here[0] == depth:
            node_here[1][s[depth]] = leaf
            continue
        branch = [depth, {node[0][depth]: node_here, s[depth]: leaf}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is list:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        else:
            out.extend(node[1])
    return out


def adjacent_lcp(rows: np.ndarray, order: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted row with the one before it (-1: first of its group)."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 4096):
        a, b = order[at - 1:at + 4095][: len(order) - at], order[at:at + 4096]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        first = np.minimum(first, np.minimum(length[a], length[b]))
        out[at:at + 4096] = np.where(group[a] == group[b], first, -1)
    return out
