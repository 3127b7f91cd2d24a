"""Scores of a block of queries against a block of vectors, within a task.

A matrix product tells which vectors may be among a query's best; its sums depend on where a row stands, so those few are scored again by themselves. Equal vectors thus have equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: By how much the score of a matrix product may be off, and how many pairs are scored again at a time.
SLACK, AGAIN = 1e-9, 1 << 16


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows have it, their vectors as a matrix) of a column of arrays without nulls."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        yield int(size), at, flat[start[at][:, None] + np.arange(size)]


def order_of(ids: pa.Array) -> np.ndarray:
    """Numbers in the ids' order, nulls first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def k_best(near: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], order: np.ndarray, k: int, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors, ties to smaller order; those below the query's floor may be left out.

    near: scores by matrix product, queries by vectors, -inf where the two weren't compared; exact: the scores of pairs, by their numbers. What isn't a number is above all, as in Spark's order.
    """
    near = np.where(np.isnan(near), np.inf, near)
    n = near.shape[1]
    floor = np.broadcast_to(floor, near.shape[:1])
    if n > k:
        floor = np.maximum(floor, np.partition(near, n - k, axis=1)[:, n - k])
    rows, columns = np.nonzero((near >= (floor - SLACK)[:, None]) & (near > -np.inf))
    score = np.concatenate([exact(rows[i : i + AGAIN], columns[i : i + AGAIN]) for i in range(0, len(rows), AGAIN)] or [np.zeros(0)])
    sorted_by = np.lexsort((order[columns], -np.where(np.isnan(score), np.inf, score), rows))
    rows, columns, score = rows[sorted_by], columns[sorted_by], score[sorted_by]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], columns[kept], score[kept]
