"""The cutting-stock problem on a histogram of lengths, by column generation."""

from __future__ import annotations

import numpy as np


def best_fillings(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity up to the given one the value of the best multiset of items, and an item of it (none: -1). Dynamic programming over capacities."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    s, v = size[order], value[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(int(s[0]) if len(s) else capacity + 1, capacity + 1):
        k = upto[c]
        with_item = best[c - s[:k]] + v[:k]
        i = with_item.argmax()
        if with_item[i] > best[c - 1]:  # an item of no value is never taken
            best[c], choice[c] = with_item[i], order[i]
        else:
            best[c] = best[c - 1]
    return best, choice


def fillings(choice: np.ndarray, size: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The best multisets for some capacities, as rows of counts."""
    last = np.maximum.accumulate(np.where(choice >= 0, np.arange(len(choice)), 0))  # the largest capacity at or below that takes an item
    count = np.zeros((len(room), len(size)), np.int64)
    rows, c = np.arange(len(room)), last[room]
    while len(rows):
        going = choice[c] >= 0
        rows, c = rows[going], c[going]
        item = choice[c]
        count[rows, item] += 1
        c = last[c - size[item]]
    return count


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within the capacity: its value and how many of each."""
    best, choice = best_fillings(value, size, capacity)
    return float(best[capacity]), fillings(choice, size, np.array([capacity]))[0]


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination; small matrices need no library threads, which fight with the executors'."""
    n = len(matrix)
    both = np.concatenate((matrix, np.eye(n)), axis=1)
    for k in range(n):
        row = k + int(np.abs(both[k:, k]).argmax())
        both[[k, row]] = both[[row, k]]
        both[k] /= both[k, k]
        others = both[:, k].copy()
        others[k] = 0
        both -= np.outer(others, both[k])
    return both[:, n:]


def patterns(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows of counts, how often each is used), to meet the demand exactly with few bins.

    The linear program over patterns is solved by the revised simplex method, from the
    patterns that first fit uses for a like demand of bounded size. A knapsack prices new patterns, the best one with each
    size in it, until the bound by its value is within `gap` or one bin; the next pattern of
    the basis is the one of the lowest cost among them, as long as one is of use. Uses are
    rounded down and what is left over is packed by first fit, largest first.
    """
    n = len(size)
    if not n:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    basis = np.diag(capacity // size).astype(float)  # columns are patterns
    inverse = np.diag(1 / np.diag(basis))
    use = (inverse * demand).sum(axis=1)
    bound, steady = float(size @ demand) / capacity, None
    best, since = use.sum(), 0
    # first fit has a row for each bin, so it packs the demand scaled down to some thousand bins
    pool = np.unique(first_fit(size, np.ceil(demand / max(1.0, bound / 1000)).astype(np.int64), capacity), axis=0).astype(float)
    for step in range(200 * n + 1000):
        since = 0 if use.sum() < best - 1e-6 * best else since + 1
        best = min(best, use.sum())
        if since > n + 50:  # steps that only change the basis: any basis gives whole patterns
            break
        price = inverse.sum(axis=0)
        worth = (pool * price).sum(axis=1)  # as with inverted(): no library threads, and no memory for them
        if not len(pool) or worth.max() <= 1 + 1e-9:
            # prices drawn towards those of the best bound so far take far fewer steps
            for drawn in (price if steady is None else 0.8 * steady + 0.2 * price, price):
                drawn = np.maximum(drawn, 0)
                value, choice = best_fillings(drawn, size, capacity)
                if (at := float(drawn @ demand) / value[capacity]) > bound or steady is None:
                    bound, steady = max(at, bound), drawn.copy()
                made = fillings(choice, size, np.concatenate(([capacity], capacity - size)))
                made[1:][np.arange(n), np.arange(n)] += 1
                made = np.unique(made[(made * price).sum(axis=1) > 1 + 1e-9], axis=0)
                if len(made):
                    break
            if not len(made):
                break
            pool = np.concatenate((pool[np.argsort(-worth, kind="stable")[: 4 * n]], made))
            worth = (pool * price).sum(axis=1)
        if use.sum() - bound <= max(gap * use.sum(), 1):
            break
        column = pool[int(worth.argmax())]
        d = (inverse * column).sum(axis=1)
        positive = d > 1e-9
        ratio = np.where(positive, use / np.where(positive, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        use = np.maximum(use - ratio[out] * d, 0)
        use[out] = ratio[out]
        if step % 200 == 199:  # against rounding errors
            inverse = inverted(basis)
            use = np.maximum((inverse * demand).sum(axis=1), 0)
    rows, times = basis.T.round().astype(np.int64), np.floor(use + 1e-9).astype(np.int64)
    left = demand - times @ rows
    for p in np.argsort(times, kind="stable"):  # rounding errors could use a piece too many
        while times[p] and (left < 0).any() and rows[p][left < 0].any():
            times[p] -= 1
            left = left + rows[p]
    leftover = first_fit(size, left, capacity)
    keep = times > 0
    rows, times = np.concatenate((rows[keep], leftover)), np.concatenate((times[keep], np.ones(len(leftover), np.int64)))
    same, back = np.unique(rows, axis=0, return_inverse=True)
    return same, np.bincount(back.ravel(), weights=times).astype(np.int64)


def first_fit(size: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """First fit, largest first, on a histogram; rows of counts."""
    rows: list[np.ndarray] = []
    room = np.zeros(0, np.int64)
    for i in np.argsort(-size, kind="stable"):
        left = int(demand[i])
        for b in np.flatnonzero(room >= size[i]):
            if not left:
                break
            k = min(left, int(room[b] // size[i]))
            rows[b][i] += k
            room[b] -= k * size[i]
            left -= k
        while left:
            k = min(left, int(capacity // size[i]))
            rows.append(np.zeros(len(size), np.int64))
            rows[-1][i] = k
            room = np.append(room, capacity - k * size[i])
            left -= k
    return np.array(rows, np.int64).reshape(-1, len(size))
