"""Byte-pair merging of many words at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max
LONGEST = 32


class PairTable:
    """Which neighbours join, in what order, and into what: rank and result by pair of symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray) -> None:
        code = left.astype(np.int64) << 32 | right.astype(np.int64)
        order = np.argsort(code)
        self.code, self.rank, self.result = code[order], rank[order].astype(np.int32), result[order].astype(np.int32)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if they don't join) and row of each pair."""
        code = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        ok = (self.code[at] == code) & (left >= 0) & (right >= 0)
        return np.where(ok, self.rank[at], NONE).astype(np.int32), at.astype(np.int32)

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged rows and their sizes. symbols: a row a word, -1 behind its end.

        In each round every word joins its pair of least rank, the leftmost of equals.
        """
        out, left = symbols.copy(), size.copy()
        rows = np.flatnonzero(size > 1)
        s = out[rows]
        rank, at = self.look(s[:, :-1], s[:, 1:])
        column = np.arange(s.shape[1])
        while len(rows):
            best = rank.argmin(1)
            line = np.arange(len(rows))
            go = rank[line, best] != NONE
            if not go.all():
                out[rows[~go]] = s[~go]
                rows, s, rank, at, best = rows[go], s[go], rank[go], at[go], best[go]
                line = np.arange(len(rows))
            if not len(rows):
                break
            s[line, best] = self.result[at[line, best]]
            source = np.minimum(column + (column > best[:, None]), s.shape[1] - 1)
            s = np.take_along_axis(s, source, 1)
            left[rows] -= 1
            s[line, left[rows]] = -1
            source = np.minimum(column[:-1] + (column[:-1] > best[:, None]), rank.shape[1] - 1)
            rank, at = np.take_along_axis(rank, source, 1), np.take_along_axis(at, source, 1)
            for k in (best - 1, best):
                ok = (k >= 0) & (k < rank.shape[1])
                r, a = self.look(s[line[ok], k[ok]], s[line[ok], np.minimum(k[ok] + 1, s.shape[1] - 1)])
                r[k[ok] + 1 >= left[rows[ok]]] = NONE
                rank[line[ok], k[ok]], at[line[ok], k[ok]] = r, a
            rank[line, np.minimum(left[rows] - 1, rank.shape[1] - 1)] = np.where(left[rows] - 1 < rank.shape[1], NONE, rank[:, -1])
        return out, left

    def merge_all(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As merge, for words one after another in flat; words of like size together."""
        end = np.cumsum(size)
        order = np.argsort(size, kind="stable")
        total, parts, done = np.zeros(len(size), np.int64), [], 0
        for most in (6, 10, 14, 20, LONGEST, max(LONGEST + 1, int(size.max(initial=0)))):
            own = order[done : np.searchsorted(size[order], most, "right")]
            done += len(own)
            if len(own):
                n = size[own]
                grid = np.full((len(own), max(2, int(n.max()))), -1, np.int32)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                grid[np.repeat(np.arange(len(own)), n), step] = flat[np.repeat(end[own] - n, n) + step]
                grid, n = self.merge(grid, n)
                total[own] = n
                parts.append((own, grid, n))
        out = np.empty(int(total.sum()), np.int32)
        begin = np.cumsum(total) - total
        for own, grid, n in parts:
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(own)), n)
            out[begin[own][row] + step] = grid[row, step]
        return out, total
