"""Optimal one-to-one assignment by shortest augmenting paths, in numpy."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row of an (n, m) cost matrix, n <= m, with the least sum. Ties go to the lower column.

    Rows enter one at a time; each is placed along the shortest augmenting path under the current prices, one
    vectorised relaxation per step (Jonker and Volgenant 1987).
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        best = np.full(m, np.inf)
        origin = np.full(m, -1)
        done = np.zeros(m, bool)
        i, last, price = row, -1, 0.0
        while True:
            free = ~done
            through = price + cost[i] - u[i] - v
            better = free & (through < best)
            best[better] = through[better]
            origin[better] = last
            j = int(np.argmin(np.where(free, best, np.inf)))
            price, last = best[j], j
            done[j] = True
            if owner[j] < 0:
                break
            i = owner[j]
        u[row] += price
        seen = done.copy()
        seen[last] = False
        u[owner[seen]] += price - best[seen]
        v[seen] -= price - best[seen]
        while last >= 0:
            before = origin[last]
            owner[last] = owner[before] if before >= 0 else row
            last = before
    out = np.full(n, -1)
    taken = np.flatnonzero(owner >= 0)
    out[owner[taken]] = taken
    return out


def groups(near: np.ndarray) -> np.ndarray:
    """For each row of a matrix of possible pairs the least row that it hangs together with."""
    n = len(near)
    label = np.arange(n)
    while True:
        column = np.where(near, label[:, None], n).min(0, initial=n)
        new = np.minimum(label, np.where(near, column[None, :], n).min(1, initial=n))
        if np.array_equal(new, label):
            return label
        label = new


def match_or_leave(cost: np.ndarray, leave_rows: np.ndarray, leave_cols: np.ndarray, barred: float = 1e5) -> list[tuple[int, int]]:
    """Pairs (row, column) of a full outer one-to-one join: each side may stay alone at its own price; pairs that
    cost ``barred`` or more are never made. Rows and columns that no chain of possible pairs joins don't bear on each other, so each group
    that hangs together is solved by itself."""
    n, m = cost.shape
    if not n or not m:
        return []
    near = cost < barred
    label, out = groups(near), []
    for group in np.unique(label[near.any(1)]).tolist():
        rows = np.flatnonzero(label == group)
        cols = np.flatnonzero(near[rows].any(0))
        out += [(int(rows[r]), int(cols[c])) for r, c in _solved(cost[np.ix_(rows, cols)], leave_rows[rows], leave_cols[cols], barred)]
    return sorted(out)


def _solved(cost: np.ndarray, leave_rows: np.ndarray, leave_cols: np.ndarray, barred: float) -> list[tuple[int, int]]:
    n, m = cost.shape
    if n == m == 1:
        return [(0, 0)] if cost[0, 0] <= leave_rows[0] + leave_cols[0] else []
    padded = np.zeros((n + m, m + n))
    padded[:n, :m] = cost
    padded[:n, m:] = 10 * barred
    padded[n:, :m] = 10 * barred
    padded[np.arange(n), m + np.arange(n)] = leave_rows
    padded[n + np.arange(m), np.arange(m)] = leave_cols
    got = assign(padded)
    return [(r, int(c)) for r, c in enumerate(got[:n]) if c < m and cost[r, c] < barred]
