"""Nearest neighbours among the raters of an item, and sets that overlap, in memory, for the workers of ``recommend``
and ``similar``.

The rows of all (target, rater) pairs grow as the square of a hot item's raters; here they only pass through the arrays
of a worker, and what leaves it is at most the best few raters of a target, or the pairs that overlap enough.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2_000_000  # rows that a worker holds at once


class Block:
    """The ratings of every ``blocks``-th x, from number ``first`` on, by y. ``d`` is compared, ``w`` is averaged."""

    def __init__(self, n_x: int, n_y: int, x: np.ndarray, y: np.ndarray, d: np.ndarray, w: np.ndarray, first: int = 0, blocks: int = 1):
        order = np.lexsort((x, y))
        self.v, self.d = (x[order] // blocks).astype(np.int32), d[order]
        self.w = self.d if w is d else w[order]  # one array is also sent to the workers, and kept on their disks, once
        self.at = np.searchsorted(y[order], np.arange(n_y + 1))
        self.n, self.first, self.blocks = -(-n_x // blocks), first, blocks

    def scratch(self, gate: int) -> list[np.ndarray]:
        """Sums of products, of either's squares and, for a gate, common ratings, of one x with every other."""
        return [np.zeros(self.n) for _ in range(4 if gate > 1 else 3)]

    def best(self, x: int, ys: np.ndarray, ds: np.ndarray, targets: np.ndarray, top: int, gate: int, sums: list[np.ndarray]):
        """For each target y of x, which rated ``ys`` by ``ds``: (y, similarities, numbers, what is averaged) of its ``top`` most
        similar raters here, ties by number. A rating that x gave the target itself is left out of the sums."""
        num, d1, d2, *common = sums
        spans = [slice(self.at[y], self.at[y + 1]) for y in ys]
        for span, dx in zip(spans, ds):
            v, dv = self.v[span], self.d[span]  # each v once
            num[v] += dx * dv
            d1[v] += dx * dx
            d2[v] += dv * dv
            for c in common:
                c[v] += 1
        given = dict(zip(ys.tolist(), ds.tolist()))
        own = x // self.blocks if x % self.blocks == self.first else -1
        for y in targets.tolist():
            span = slice(self.at[y], self.at[y + 1])
            v, s = self.v[span], np.zeros(self.at[y + 1] - self.at[y])
            p, dx = num[v], given.get(y)
            some = np.flatnonzero(p) if dx is None else np.arange(len(v))  # without the target itself a sum of 0 may be none
            if len(some):
                u = v[some]
                p, a, b = p[some], d1[u], d2[u]
                if dx is not None:
                    dv = self.d[span][some]
                    p, a, b = p - dx * dv, a - dx * dx, b - dv * dv
                real = np.abs(p) >= 5e-10  # what does not round to 0 at nine decimals
                for c in common:
                    real &= c[u] >= gate
                s[some[real]] = np.round(p[real] / np.sqrt(a[real] * b[real]), 9)
            if own >= 0 and (k := np.searchsorted(v, own)) < len(v) and v[k] == own:
                s[k] = -np.inf
            pick = np.arange(len(s))
            if len(s) > top:
                pick = np.flatnonzero(s >= -np.partition(-s, top - 1)[top - 1])
            pick = pick[np.argsort(-s[pick], kind="stable")][:top]
            pick = pick[s[pick] > -np.inf]
            yield y, s[pick], v[pick].astype(np.int64) * self.blocks + self.first, self.w[span][pick]
        for span in spans:
            v = self.v[span]
            for z in sums:
                z[v] = 0


class Holders:
    """The holders of each member y: of every ``blocks``-th set x, from number ``first`` on."""

    def __init__(self, n_x: int, n_y: int, x: np.ndarray, y: np.ndarray, first: int = 0, blocks: int = 1):
        order = np.lexsort((x, y))
        self.v = (x[order] // blocks).astype(np.int32)
        self.at = np.searchsorted(y[order], np.arange(n_y + 1))
        self.n, self.first, self.blocks = -(-n_x // blocks), first, blocks

    def overlapping(self, x: int, ys: np.ndarray, least: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, common members) of the sets after x that share at least ``least`` of its members ``ys``.

        Such a set holds one of any ``len(ys) - least + 1`` members of x: the rarest name the candidates, in the others
        the candidates are only looked up. ``counts`` is all 0 before and after.
        """
        ys = ys[np.argsort(self.at[ys + 1] - self.at[ys], kind="stable")]
        after, cut, fresh = (x - self.first) // self.blocks, max(0, len(ys) - least + 1), [np.zeros(0, np.int32)]
        for y in ys[:cut]:
            v = self.v[self.at[y] : self.at[y + 1]]
            v = v[np.searchsorted(v, after, "right") :]
            fresh.append(v[counts[v] == 0])
            counts[v] += 1
        found = np.concatenate(fresh)
        if len(found):
            for y in ys[cut:]:
                v = self.v[self.at[y] : self.at[y + 1]]
                if len(v):
                    counts[found] += v[np.minimum(np.searchsorted(v, found), len(v) - 1)] == found
        n = counts[found]
        counts[found] = 0
        return found[n >= least].astype(np.int64) * self.blocks + self.first, n[n >= least]


def groups(batches):
    """(x, ys, ds, targets) of Arrow batches of (x, y, d) rows ordered by x; a target has no d. No group is cut."""
    rest: list[tuple[np.ndarray, ...]] = []

    def split(parts):
        x, y, d = (np.concatenate(c) for c in zip(*parts))
        ends = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)]
        return x, y, d, ends

    def group(x, y, d, a, b):
        is_target = np.isnan(d[a:b])
        return int(x[a]), y[a:b][~is_target], d[a:b][~is_target], y[a:b][is_target]

    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, d = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        rest.append((x, y, d.astype(float)))
        if x[-1] == rest[0][0][0]:
            continue
        x, y, d, ends = split(rest)
        for a, b in zip(ends[:-2], ends[1:-1]):
            yield group(x, y, d, a, b)
        rest = [(x[ends[-2] :], y[ends[-2] :], d[ends[-2] :])]
    if rest:
        x, y, d, ends = split(rest)
        for a, b in zip(ends[:-1], ends[1:]):
            yield group(x, y, d, a, b)
