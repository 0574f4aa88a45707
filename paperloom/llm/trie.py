"""Self-join of binary tries over sorted 64-bit values, many node pairs at a time.

A node is a range of the sorted values that agree in their leading bits; the trie
is path-compressed, so a node's two children part at the highest bit in which its
values differ. Pairs of nodes are traversed together from each trie's root paired
with itself: the bits that both prefixes have come to fix are compared once, on
the way down, and added to the pair's errors; a pair over the budget is dropped,
and so is one whose nodes already lie wholly in one component. Pairs of single
values that are left are links. Pending pairs are kept on a stack of arrays and
taken ``CHUNK`` at a time, the deepest first, so memory follows depth and not the
number of pairs, and early links spare later pairs.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np

CHUNK = 1 << 18
_ONE = np.uint64(1)


class Accept(Protocol):
    """Decides links. ``likely`` may let pass what ``accept`` rejects, never the reverse."""

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray: ...

    def accept(self, i: int, js: np.ndarray) -> np.ndarray: ...


def bit_length(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return np.bitwise_count(x).astype(np.int64)


class TrieJoin:
    """Components of values within ``budget`` bits of each other.

    ``values`` are sorted within each trie (equal ones are leaves that part at
    bit 0); ``starts`` and ``ends``
    are the tries' ranges (one trie of all values without them). ``accept``
    decides which links hold; all do without it. ``visited`` and ``pruned`` count
    node pairs."""

    def __init__(self, values: np.ndarray, budget: int, starts: np.ndarray | None = None, ends: np.ndarray | None = None, accept: Accept | None = None) -> None:
        self.v, self.budget, self.accept = values, budget, accept
        n = len(values)
        self.starts = np.zeros(1, np.int64) if starts is None else starts.astype(np.int64)
        self.ends = np.full(1, n, np.int64) if ends is None else ends.astype(np.int64)
        self.comp = np.arange(n)
        self.members: dict[int, np.ndarray] = {}
        self.visited = self.pruned = 0
        # where values part at each bit, by bit and place
        self._parts = np.sort(bit_length(values[1:] ^ values[:-1]) * (n + 1) + np.arange(1, n)) if n else np.zeros(0, np.int64)
        self._changes = np.arange(n)

    def _split(self, lo: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """First place after ``lo`` at which values part at ``bit``."""
        n = len(self.v) + 1
        return self._parts[np.searchsorted(self._parts, bit * n + lo, "right")] - bit * n

    def _whole(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Nodes that lie in one component."""
        return self._changes[lo] == self._changes[hi - 1]

    def _union(self, a: int, b: int) -> None:
        ca, cb = int(self.comp[a]), int(self.comp[b])
        if ca == cb:
            return
        ma, mb = self.members.pop(ca, None), self.members.pop(cb, None)
        ma, mb = (np.array([x]) if m is None else m for x, m in ((ca, ma), (cb, mb)))
        if len(ma) < len(mb):
            ca, ma, mb = cb, mb, ma
        self.comp[mb] = ca
        self.members[ca] = np.concatenate([ma, mb])

    def _link(self, i: np.ndarray, j: np.ndarray, errors: np.ndarray) -> None:
        if self.accept is None:
            _, at = np.unique(np.minimum(self.comp[i], self.comp[j]) * len(self.v) + np.maximum(self.comp[i], self.comp[j]), return_index=True)
            for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True):
                self._union(a, b)
        else:
            likely = self.accept.likely(i, j)
            i, j, errors = i[likely], j[likely], errors[likely]
            for least, most in ((-1, 8), (8, 64)):  # the nearest first: they spare the others
                tier = np.flatnonzero((errors > least) & (errors <= most) & (self.comp[i] != self.comp[j]))
                if not len(tier):
                    continue
                order = tier[np.argsort(i[tier], kind="stable")]
                cut = np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])
                for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    a, js = int(i[order[x]]), j[order[x:y]]
                    js = js[self.comp[js] != self.comp[a]]
                    if len(js):
                        for b in js[self.accept.accept(a, js)].tolist():
                            self._union(a, b)
        self._changes = np.zeros(len(self.v), np.int64)
        np.cumsum(self.comp[1:] != self.comp[:-1], out=self._changes[1:])

    def join(self) -> np.ndarray:
        """Component of each value, as the place of one of its members."""
        big = self.ends - self.starts > 1
        s, e = self.starts[big], self.ends[big]
        zero = np.zeros(len(s), np.int64)
        stack = [(s, e, s, e, zero, zero)]
        while stack:
            pairs = stack.pop()
            if len(pairs[0]) > CHUNK:
                stack.append(tuple(x[CHUNK:] for x in pairs))
                pairs = tuple(x[:CHUNK] for x in pairs)
            self.visited += len(pairs[0])
            own, next_ = pairs[0] == pairs[2], []
            if own.any():
                lo, hi = pairs[0][own], pairs[1][own]
                open_ = ~self._whole(lo, hi)
                self.pruned += int((~open_).sum())
                lo, hi = lo[open_], hi[open_]
                bit = bit_length(self.v[lo] ^ self.v[hi - 1])
                mid = self._split(lo, bit)
                zero = np.zeros(len(lo), np.int64)
                next_.append((lo, mid, mid, hi, bit, zero))
                for a, b in ((lo, mid), (mid, hi)):
                    more = b - a > 1
                    next_.append((a[more], b[more], a[more], b[more], zero[more], zero[more]))
            if not own.all():
                next_ += self._cross(tuple(x[~own] for x in pairs))
            if any(len(x[0]) for x in next_):  # all of a step in one array, lest arrays become many and small
                stack.append(tuple(np.concatenate(x) for x in zip(*next_, strict=True)))
        return self.comp

    def _cross(self, pairs: tuple[np.ndarray, ...]) -> list[tuple[np.ndarray, ...]]:
        """Links the pairs of single values within the budget; the pairs below the others."""
        alo, ahi, blo, bhi, at, errors = pairs
        v = self.v
        abit, bbit = bit_length(v[alo] ^ v[ahi - 1]), bit_length(v[blo] ^ v[bhi - 1])
        to = np.maximum(abit, bbit)
        # bits [to, at) have come to be fixed on both sides
        low = np.where(at >= 64, ~np.uint64(0), (_ONE << np.minimum(at, 63).astype(np.uint64)) - _ONE)
        new = ((v[alo] ^ v[blo]) & low) >> np.minimum(to, 63).astype(np.uint64)
        errors = errors + np.bitwise_count(np.where(to >= 64, np.uint64(0), new)).astype(np.int64)
        keep = errors <= self.budget
        keep &= ~((self.comp[alo] == self.comp[blo]) & self._whole(alo, ahi) & self._whole(blo, bhi))
        self.pruned += int((~keep).sum())
        one = ahi - alo == 1
        leaf = keep & one & (bhi - blo == 1)
        a = keep & ~leaf & ((abit > bbit) | ((abit == bbit) & ~one))
        b = keep & ~leaf & ~a
        ma, mb = self._split(alo[a], abit[a]), self._split(blo[b], bbit[b])
        if leaf.any():
            self._link(alo[leaf], blo[leaf], errors[leaf])
        return [
            (alo[a], ma, blo[a], bhi[a], to[a], errors[a]),
            (ma, ahi[a], blo[a], bhi[a], to[a], errors[a]),
            (alo[b], ahi[b], blo[b], mb, to[b], errors[b]),
            (alo[b], ahi[b], mb, bhi[b], to[b], errors[b]),
        ]
