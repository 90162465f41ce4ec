"""Shortest-path tallies of one source after another, by tasks that hold all arcs.

A walk as a frame moves its whole state once a level; a task that holds the arcs looks at each arc
that it reaches twice. Only arcs few enough to be sent to every task are walked here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "bound INT, v BIGINT, tally DOUBLE, n BIGINT"
# Stands for no bound, and for the rows that count pairs by distance.
UNBOUND, PAIRS = 2**31 - 1, -1


def held_arcs(arcs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``src, dst`` as sorted vertex numbers, the first arc of each vertex (and their end), and the
    places of the vertices that arcs lead to.
    """
    table = arcs.select("src", "dst").toArrow()
    src, dst = (table[name].to_numpy() for name in ("src", "dst"))
    numbers = np.unique(np.concatenate([src, dst]))
    starts, ends = np.searchsorted(numbers, src), np.searchsorted(numbers, dst)
    first = np.concatenate([[0], np.cumsum(np.bincount(starts, minlength=len(numbers)))])
    return numbers, first.astype(np.int64), ends[np.argsort(starts, kind="stable")].astype(np.int32)


def tallier(shared, bounds: tuple[int, ...], pairs: bool = False) -> Callable[[Iterator], Iterator]:
    """For ``mapInArrow`` over numbered sources ``s``: rows ``ROWS`` of each task.

    Per bound and vertex: the path dependencies of the task's sources and how many of them reach it.
    With ``pairs``, rows of the bound ``PAIRS`` count the pairs s < v by their distance, as ``v``.
    """
    last = max(bounds)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, first, ends_of = shared.value
        size = len(numbers)
        depth = np.full(size, -1, np.int32)
        sigma, delta = np.zeros(size), np.zeros(size)
        tally = {bound: np.zeros(size) for bound in bounds}
        met = {bound: np.zeros(size, np.int64) for bound in bounds}
        apart: dict[int, int] = {}

        def leaving(level):
            """The ends of all arcs that leave a level, and how many leave each vertex."""
            counts = first[level + 1] - first[level]
            upto = np.cumsum(counts)
            at = np.arange(counts.sum()) + np.repeat(first[level] - upto + counts, counts)
            return ends_of[at], counts

        def summed(vertices, amounts):
            """Distinct vertices with the sum of their amounts."""
            if len(vertices) * 8 > size:
                there = np.zeros(size, bool)
                there[vertices] = True
                found = np.flatnonzero(there)
                return found, np.bincount(vertices, amounts, size)[found]
            found, place = np.unique(vertices, return_inverse=True)
            return found, np.bincount(place, amounts, len(found))

        def forward(source):
            """The vertices at each distance; ``sigma`` counts the shortest paths to them."""
            levels = [np.array([source])]
            depth[source], sigma[source] = 0, 1.0
            while len(levels) <= last:
                ends, counts = leaving(levels[-1])
                new = depth[ends] < 0
                found, paths = summed(ends[new], np.repeat(sigma[levels[-1]], counts)[new])
                if len(found) == 0:
                    break
                depth[found], sigma[found] = len(levels), paths
                levels.append(found)
            return levels

        def backward(levels):
            """``delta``: how much of the paths to other vertices leads over each."""
            for level in levels:
                delta[level] = 0.0
            for d in range(len(levels) - 1, 1, -1):
                ends, counts = leaving(levels[d])
                share = np.repeat((1 + delta[levels[d]]) / sigma[levels[d]], counts)
                up = depth[ends] == d - 1
                found, shares = summed(ends[up], share[up])
                delta[found] = sigma[found] * shares

        for batch in batches:
            sources = batch.column("s").to_numpy(zero_copy_only=False)
            for source in np.flatnonzero(np.isin(numbers, sources)):
                levels = forward(source)
                for bound in bounds:
                    near = levels[: bound + 1]
                    backward(near)
                    for level in near[1:]:
                        tally[bound][level] += delta[level]
                        met[bound][level] += 1
                for d, level in enumerate(levels):
                    depth[level] = -1
                    apart[d] = apart.get(d, 0) + int((level > source).sum())

        def rows(bound, v, sums, counts):
            columns = [np.full(len(v), bound, np.int32), v, sums, counts]
            made = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bound", "v", "tally", "n"])
            for start in range(0, len(v), 100_000):
                yield made.slice(start, 100_000)

        for bound in bounds:
            reached = np.flatnonzero(met[bound])
            yield from rows(bound, numbers[reached], tally[bound][reached], met[bound][reached])
        if pairs:
            found = [(d, n) for d, n in apart.items() if n]
            d, n = (np.array([x[i] for x in found], np.int64) for i in range(2))
            yield from rows(PAIRS, d, np.zeros(len(d)), n)

    return walked
