"""Binary-trie self-join of bit codes inside one task.

Codes are sorted, so a trie node is a range of rows that share a prefix. Pairs of nodes
are traversed together; each step adds the bit by which the two children differ and a
pair is dropped as soon as its differing bits exceed what is allowed at that depth. Only a
chunk of the frontier is expanded at a time, which bounds memory whatever the codes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs expanded at once, and code pairs compared at once.
CHUNK, COMPARED = 1 << 16, 1 << 20
#: Two nodes of at most so many codes each are compared directly.
LEAF = 16


def bit_split(code: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First row of each range whose bit ``depth`` (of all words, from the highest) is set."""
    word, shift, lo, hi = code[:, depth >> 6], np.uint64(63 - (depth & 63)), lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (word[np.where(open_, mid, 0)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _compare(codes: np.ndarray, nodes: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code pairs of the node pairs (alo, ahi, blo, bhi) within what is allowed at each word's end.

    All node pairs are compared as squares of LEAF by LEAF codes; what is beyond a node's end
    is left out afterwards, among the few pairs that are close in the first word.
    """
    step, last = COMPARED // LEAF**2, len(codes) - 1
    for s in range(0, nodes.shape[1], step):
        alo, ahi, blo, bhi = nodes[:, s : s + step]
        a = np.minimum(alo[:, None] + np.arange(LEAF), last)
        b = np.minimum(blo[:, None] + np.arange(LEAF), last)
        differ = np.bitwise_count(codes[a, 0][:, :, None] ^ codes[b, 0][:, None, :])
        node, x, y = np.nonzero(differ <= min(allowed[64], 64))
        i, j, differ = alo[node] + x, blo[node] + y, differ[node, x, y].astype(np.int64)
        inside = (i < ahi[node]) & (j < bhi[node]) & (i < j)
        i, j, differ = i[inside], j[inside], differ[inside]
        for word in range(1, codes.shape[1]):
            differ = differ + np.bitwise_count(codes[i, word] ^ codes[j, word])
            near = differ <= allowed[64 * (word + 1)]
            i, j, differ = i[near], j[near], differ[near]
        yield i, j


def close_pairs(codes: np.ndarray, nodes: np.ndarray, depth: int, budget: int, allowed: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j of ``codes`` (rows x 64-bit words) at most ``budget`` bits apart.

    ``nodes`` holds the starting node pairs as rows alo, ahi, blo, bhi; inside a node rows
    are sorted and share their first ``depth`` bits. A pair of a node with itself has equal
    ranges; otherwise the a range ends before the b range begins. ``allowed[d]``: bits that may
    differ among the first ``d`` (the whole budget, if not given); a tighter row of limits
    prunes earlier and finds only pairs that stay within it.
    """
    bits = 64 * codes.shape[1]
    allowed = np.full(bits + 1, budget) if allowed is None else np.minimum(allowed, budget)
    stack = [(nodes[:, s : s + CHUNK], np.zeros(min(CHUNK, nodes.shape[1] - s), np.int64), depth) for s in range(0, nodes.shape[1], CHUNK)]
    while stack:
        node, err, d = stack.pop()
        alo, ahi, blo, bhi = node
        small = (ahi - alo <= LEAF) & (bhi - blo <= LEAF)
        if small.any():
            yield from _compare(codes, node[:, small], allowed)
            node, err = node[:, ~small], err[~small]
            alo, ahi, blo, bhi = node
        if not node.shape[1]:
            continue
        same = alo == blo
        if d < bits:
            amid, bmid = bit_split(codes, alo, ahi, d), bit_split(codes, blo, bhi, d)
            cross, deeper = 1, d + 1
        else:  # equal codes: halve the ranges
            amid, bmid, cross, deeper = (alo + ahi) >> 1, (blo + bhi) >> 1, 0, d
        kids = [
            (np.stack([alo, amid, blo, bmid]), err, np.ones(len(err), bool)),
            (np.stack([amid, ahi, bmid, bhi]), err, np.ones(len(err), bool)),
            (np.stack([alo, amid, bmid, bhi]), err + cross, np.ones(len(err), bool)),
            (np.stack([amid, ahi, blo, bmid]), err + cross, ~same),
        ]
        node = np.concatenate([k for k, _, _ in kids], axis=1)
        err = np.concatenate([e for _, e, _ in kids])
        keep = np.concatenate([ok for _, _, ok in kids]) & (node[0] < node[1]) & (node[2] < node[3]) & (err <= allowed[deeper])
        keep &= ~((node[0] == node[2]) & (node[1] == node[3]) & (node[1] - node[0] < 2))  # a single row with itself
        node, err = node[:, keep], err[keep]
        stack += [(node[:, s : s + CHUNK], err[s : s + CHUNK], deeper) for s in range(0, node.shape[1], CHUNK)]


class Forest:
    """Union of row pairs, by hooking the larger root under the smaller one."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up
