"""Binary-trie self-join of bit strings: pairs within a Hamming budget.

A sorted block of keys is a binary trie: the keys below a node are a range, and its two children meet where
the next bit turns on. Pairs of nodes are traversed together, all pairs of one depth at a time; a pair carries
the bits in which its two nodes differ so far and is pruned once they exceed the budget.
"""

from __future__ import annotations

import numpy as np

#: A node pair with so few key pairs is compared key by key.
LEAF_PAIRS = 32
#: Node pairs that are split at a time; the rest wait on a stack, which bounds memory.
CHUNK = 1 << 18


def _expand(alo, ahi, blo, bhi):
    """All (i, j) of the ranges alo:ahi x blo:bhi."""
    na, nb = ahi - alo, bhi - blo
    n = na * nb
    at = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return alo[at] + k // nb[at], blo[at] + k % nb[at]


def close_pairs(keys: np.ndarray, starts: np.ndarray, first_bit: int, budget: int, cuts: np.ndarray | None = None, chunk: int = CHUNK):
    """Yield (i, j, differing bits) arrays, i < j, of all pairs of one group within ``budget``.

    keys: (n, words) uint64, sorted within each group by all bits, most significant first; starts: where groups
    begin; first_bit: bits before it are equal within a group. cuts: where the second of two nodes begins in a group
    that asks only for the pairs between them, else the group's start. chunk: node pairs that are split at a time.
    """
    n, words = keys.shape
    ends = np.append(starts[1:], n)
    cuts = starts if cuts is None else cuts
    roots = np.stack([starts, np.where(cuts > starts, cuts, ends), cuts, ends, np.zeros_like(starts)]).astype(np.int64)
    stack = [(first_bit, roots[:, ends - starts > 1])]
    sums: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in sums:
            column = (keys[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)
            sums[bit] = np.concatenate([[0], np.cumsum(column.astype(np.int64))])
        return sums[bit]

    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > chunk:
            stack.append((bit, pairs[:, chunk:]))
            pairs = pairs[:, :chunk]
        alo, ahi, blo, bhi, dist = pairs
        done = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        if bit == 64 * words:
            done[:] = True
        if done.any():
            i, j = _expand(alo[done], ahi[done], blo[done], bhi[done])
            keep = i < j
            i, j = i[keep], j[keep]
            d = np.bitwise_count(keys[i] ^ keys[j]).sum(axis=1)
            near = d <= budget
            if near.any():
                yield i[near], j[near], d[near]
        pairs = pairs[:, ~done]
        if not pairs.shape[1]:
            continue
        alo, ahi, blo, bhi, dist = pairs
        ones = ones_before(bit)
        am, bm = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        one = alo == blo  # a node with itself
        children = np.concatenate(
            [
                np.stack([alo, am, blo, bm, dist]),
                np.stack([am, ahi, bm, bhi, dist]),
                np.stack([alo, am, bm, bhi, dist + 1]),
                np.stack([am, ahi, blo, bm, dist + 1])[:, ~one],
            ],
            axis=1,
        )
        live = (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)
        live &= (children[0] != children[2]) | (children[1] - children[0] > 1)
        if live.any():
            stack.append((bit + 1, children[:, live]))


class Forest:
    """Union-find over row numbers: keeps the pairs that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def joins(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
