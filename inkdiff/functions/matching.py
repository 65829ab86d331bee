"""Assignment over a sparse graph of scores, and the prices that prove its result."""

from __future__ import annotations

import heapq

import numpy as np

#: Bids that each place may make on the mean before augmenting paths settle the rest.
BIDS = 12


def sparse_assign(n: int, m: int, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one-to-one pairs (i, j) of greatest total score; any place may stay alone, and no score is negative.

    Returns partner (of each of the n places; -1: alone) and prices u, v, none negative: u[i] + v[j] is at least every
    score given and equal to it where i and j are partners, and a place that stays alone has the price 0. So their sum is
    the total, and no pair that was not given belongs to a better assignment unless its score exceeds u[i] + v[j].

    First the places bid as in an auction: each raises the price of its best column to where its second best (or to stay
    alone) is as good, and puts out who held it. Who is left when bids no longer raise a price, or after BIDS bids a place,
    is placed by a shortest augmenting path over what the prices leave of the scores.
    """
    order = np.argsort(i, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(i, minlength=n)))).tolist()
    to, worth = j[order].tolist(), score[order].tolist()
    u, v = [0.0] * n, [0.0] * m
    partner, owner = [-1] * n, [-1] * m
    waiting, left, bids = list(range(n - 1, -1, -1)), [], BIDS * n
    while waiting:
        row = waiting.pop()
        best, at, second, other = 0.0, -1, 0.0, -1
        for e in range(starts[row], starts[row + 1]):
            gain = worth[e] - v[to[e]]
            if gain > best:
                best, at, second, other = gain, to[e], best, at
            elif gain > second:
                second, other = gain, to[e]
        u[row] = best
        if at < 0:
            continue  # stays alone: no column is worth its price
        if owner[at] >= 0 and best <= second and other >= 0 and owner[other] < 0:
            at = other
        if owner[at] >= 0 and (best <= second or bids <= 0):
            left.append(row)
            continue
        bids -= 1
        if owner[at] >= 0:
            partner[owner[at]] = -1
            waiting.append(owner[at])
        if best > second:
            v[at] += best - second
        u[row], owner[at], partner[row] = second, row, at
    for row in left:
        _augment(row, starts, to, worth, u, v, partner, owner)
    return np.array(partner, np.int64), np.array(u), np.array(v)


def _augment(root: int, starts: list, to: list, worth: list, u: list, v: list, partner: list, owner: list) -> None:
    """Place the root: on a free column, or in the place of one that then stays alone, whichever costs the total least."""
    u[root] = max([0.0, *(worth[e] - v[to[e]] for e in range(starts[root], starts[root + 1]))])
    rows, columns, came = {root: 0.0}, {}, {}  # distances, final for rows and for columns once they leave the heap
    heap: list[tuple[float, int]] = []
    row, far = root, 0.0
    end, end_row, end_column = u[root], root, -1
    while True:
        if far + u[row] < end:
            end, end_row, end_column = far + u[row], row, -1
        for e in range(starts[row], starts[row + 1]):
            c = to[e]
            d = far + max(0.0, u[row] + v[c] - worth[e])
            if d < end and d < columns.get(c, (np.inf, False))[0]:
                columns[c], came[c] = (d, False), row
                if owner[c] < 0:
                    end, end_row, end_column = d, -1, c
                else:
                    heapq.heappush(heap, (d, c))
        while heap and columns[heap[0][1]] != (heap[0][0], False):
            heapq.heappop(heap)
        if not heap or heap[0][0] >= end:
            break
        far, c = heapq.heappop(heap)
        columns[c] = (far, True)
        row = owner[c]
        rows[row] = far
    for r, d in rows.items():
        u[r] = max(0.0, u[r] - (end - d))
    for c, (d, final) in columns.items():
        if final:
            v[c] += end - d
    # walk back: each row on the path takes the column that the search reached from it
    if end_column < 0:
        column, partner[end_row] = partner[end_row], -1
        if end_row == root:
            return
    else:
        column = end_column
    while True:
        r = came[column]
        owner[column], partner[r], column = r, column, partner[r]
        if r == root:
            return
