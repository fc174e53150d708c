"""Signature trees over token bitmaps, and their dual traversal.

A document's signature is a bitmap of hashed tokens and its set size. Leaves hold a few
documents of like size, nodes the OR of their bitmaps and the range of their sizes. The
dual traversal starts with (root, root) and drops a pair of nodes when no two documents
below them can reach the threshold: tokens in common lie on bits in common, so the
overlap is at most those bits plus the tokens that share a bit with others of their set.
"""

from __future__ import annotations

import numpy as np

#: Bits of a map: at least twice the set's size, within these limits.
LEAST_BITS, MOST_BITS = 2048, 1 << 17
LEAF, FAN = 16, 4
#: J >= UP / DOWN, in whole numbers.
UP, DOWN = 3, 4


def bitmap(tokens: np.ndarray) -> bytes:
    """A map of the tokens; larger sets have larger maps, so that none fills up."""
    width = LEAST_BITS
    while width < 2 * len(tokens) and width < MOST_BITS:
        width *= 2
    bits = np.zeros(width, dtype=np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """(maps, words) of maps of several widths, folded to the least of them: a token's bit is its hash modulo the width."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, least // 8), axis=0) for m in maps])


class SignatureTree:
    """Built bottom-up over documents ordered by size, then bitmap, so that like ones share a leaf."""

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((*bits.T[:2], size))
        self.size, self.bits = size[self.order], bits[self.order]
        self.slack = self.size - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.nodes: list[tuple] = []  # (from, to, children, OR, least size, largest size, most slack)
        level = [self._node(i, min(i + LEAF, len(size)), ()) for i in range(0, len(size), LEAF)]
        while len(level) > 1:
            level = [self._node(self.nodes[g[0]][0], self.nodes[g[-1]][1], tuple(g)) for g in (level[k : k + FAN] for k in range(0, len(level), FAN))]
        self.root = level[0]

    def _node(self, lo: int, hi: int, children: tuple) -> int:
        either = np.bitwise_or.reduce([self.nodes[c][3] for c in children]) if children else np.bitwise_or.reduce(self.bits[lo:hi], axis=0)
        self.nodes.append((lo, hi, children, either, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), int(self.slack[lo:hi].max())))
        return len(self.nodes) - 1

    def _possible(self, a: tuple, b: tuple) -> bool:
        if UP * b[4] > DOWN * a[5] or UP * a[4] > DOWN * b[5]:
            return False
        common = int(np.bitwise_count(a[3] & b[3]).sum()) + max(a[6], b[6])
        return (UP + DOWN) * min(common, a[5], b[5]) >= UP * (a[4] + b[4])

    def pairs(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, estimated Jaccard) of all pairs of unlike label that may reach the threshold, i and j as given to the tree."""
        labels = labels[self.order]
        out: list[tuple] = []
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            a, b = self.nodes[x], self.nodes[y]
            one = labels[a[0]]
            if (labels[a[0] : a[1]] == one).all() and (labels[b[0] : b[1]] == one).all():
                continue
            if not self._possible(a, b):
                continue
            if not a[2] and not b[2]:
                out.append(self._leaves(a, b, labels, x == y))
            elif x == y:
                stack += [(p, q) for k, p in enumerate(a[2]) for q in a[2][k:]]
            elif a[2] and (not b[2] or a[1] - a[0] >= b[1] - b[0]):
                stack += [(p, y) for p in a[2]]
            else:
                stack += [(x, q) for q in b[2]]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, e = (np.concatenate(c) for c in zip(*out, strict=True))
        return self.order[i], self.order[j], e

    def _leaves(self, a: tuple, b: tuple, labels: np.ndarray, same: bool) -> tuple:
        p, q = self.bits[a[0] : a[1]], self.bits[b[0] : b[1]]
        m, n = self.size[a[0] : a[1], None], self.size[None, b[0] : b[1]]
        common = np.bitwise_count(p[:, None, :] & q[None, :, :]).sum(axis=2, dtype=np.int64)
        most = np.minimum(common + np.minimum(self.slack[a[0] : a[1], None], self.slack[None, b[0] : b[1]]), np.minimum(m, n))
        ok = ((UP + DOWN) * most >= UP * (m + n)) & (labels[a[0] : a[1], None] != labels[None, b[0] : b[1]])
        if same:
            ok &= np.triu(np.ones_like(ok), 1)
        i, j = np.nonzero(ok)
        # Linear counting of the union tells how alike the pair probably is; full bitmaps tell nothing.
        union = np.bitwise_count(p[i] | q[j]).sum(axis=1, dtype=np.int64)
        total = self.size[a[0] + i] + self.size[b[0] + j]
        width = 64 * self.bits.shape[1]
        count = np.maximum(np.maximum(self.size[a[0] + i], self.size[b[0] + j]), -width * np.log(np.maximum(1.0 - union / width, 1e-9)))
        return a[0] + i, b[0] + j, np.where(union > 0.97 * width, most[i, j] / (total - most[i, j]), np.maximum(0.0, (total - count) / count))


def spanning(i: np.ndarray, j: np.ndarray, likeness: np.ndarray, n: int, least: float = 0.68) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are probably linked, likeliest pairs first."""
    up = list(range(n))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    chosen = []
    for k in np.argsort(-likeness, kind="stable"):
        if likeness[k] < least:
            break
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            up[b] = a
            chosen.append((int(i[k]), int(j[k])))
    return chosen
