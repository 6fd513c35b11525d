"""Maximum-weight matching of two small point sets, inside the tracking folds: a few hundred points a scan pair."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of an n x m table, n <= m, by shortest augmenting paths."""
    n, m = cost.shape
    u, v, row_of, out = [0.0] * n, np.zeros(m), [-1] * m, np.full(n, -1)
    for i in range(n):
        least = cost[i] - v
        there = int(least.argmin())
        at = float(least[there])
        back, done, ways = np.full(m, -1), [], []
        while row_of[there] >= 0:  # from the column's row on; done columns are at infinity
            done.append(there)
            ways.append(at)
            r = row_of[there]
            slack = cost[r] - v
            slack += at - u[r]
            slack[done] = least[there] = np.inf
            np.copyto(back, there, where=slack < least)
            np.minimum(least, slack, out=least)
            there = int(least.argmin())
            at = float(least[there])
        u[i] = at
        for j, way in zip(done, ways, strict=True):
            u[row_of[j]] += at - way
            v[j] -= at - way
        while there >= 0:
            before = int(back[there])
            row_of[there] = row_of[before] if before >= 0 else i
            out[row_of[there]] = there
            there = before
    return out


def best_pairs(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching with the greatest total gain; a gain of 0 or less is no edge. Each connected part is solved on its own."""
    gain = np.maximum(np.asarray(gain, float), 0)
    left, right = np.nonzero(gain.any(1))[0].tolist(), {}
    seen, out = set(), []
    for start in left:
        if start in seen:
            continue
        rows, cols, todo = {start}, set(), [start]
        while todo:
            for c in np.nonzero(gain[todo.pop()])[0].tolist():
                if c not in cols:
                    cols.add(c)
                    if c not in right:
                        right[c] = np.nonzero(gain[:, c])[0].tolist()
                    for r in right[c]:
                        if r not in rows:
                            rows.add(r)
                            todo.append(r)
        seen |= rows
        a, b = sorted(rows), sorted(cols)
        part = gain[np.ix_(a, b)]
        # dummy columns: a row may stay alone
        cost = np.concatenate((-part, np.zeros((len(a), len(a)))), 1)
        out += [(a[i], b[j]) for i, j in enumerate(assign(cost).tolist()) if j < len(b) and part[i, j] > 0]
    return sorted(out)
