"""Sources walked one by one by tasks that hold the arcs give what walks as frames give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orgweft.operators import graph as G

# Two components, a hub, a ring with several shortest paths, a chain, and vertices without arcs.
PAIRS = [(0, n) for n in range(1, 6)] + [(5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (9, 10), (10, 11), (11, 12)]
PAIRS += [(20, 21), (21, 22), (22, 23), (23, 20), (22, 24)]


@pytest.fixture(scope="module")
def graph(spark):
    arcs = spark.createDataFrame([(f"p{a:02}", f"p{b:02}") for a, b in PAIRS], "src STRING, dst STRING")
    alone = spark.createDataFrame([("p15",), ("p30",)], "v STRING")
    return G.build_graph(arcs, alone)


def _both(monkeypatch, work):
    framed = work()

    def refused(*_args, **_kw):
        raise AssertionError("walked as frames")

    monkeypatch.setattr(G, "ROWS_AS_FRAMES", -1)
    monkeypatch.setattr(G, "_walk", refused)
    return framed, work()


def _rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())


@pytest.mark.parametrize("bound", [None, 1, 2, 4])
def test_tallies(graph, monkeypatch, bound):
    some = G.all_sources(graph).where("v NOT IN ('p03', 'p21', 'p30')")
    for sources in (G.all_sources(graph), some, some.union(some), some.where("v = 'none'")):
        framed, held = _both(monkeypatch, lambda sources=sources: [_rounded(x) for x in G.path_tallies(graph, sources, bound)])
        monkeypatch.undo()
        assert held == framed
    assert any(row[1] for row in [_rounded(x) for x in G.path_tallies(graph, some, 4)][0])


def test_betweenness_and_lengths(graph, monkeypatch):
    work = lambda: (_rounded(G.betweenness_exact(graph)), _rounded(G.length_sweep(graph, range(1, 7), 5)))
    framed, held = _both(monkeypatch, work)
    assert held == framed and len(held[0]) == 20 and any(row[1] for row in held[0])


def test_bounds_must_be_positive(graph):
    with pytest.raises(ValueError):
        G.path_tallies(graph, G.all_sources(graph), 0)


def test_no_arcs(spark, monkeypatch):
    arcs = spark.createDataFrame([], "src STRING, dst STRING")
    graph = G.build_graph(arcs, spark.createDataFrame([("a",), ("b",)], "v STRING"))
    framed, held = _both(monkeypatch, lambda: [_rounded(G.betweenness_exact(graph)), _rounded(G.length_sweep(graph, range(2, 4), 2, 2))])
    assert held == framed and [row[1] for row in held[0]] == [0.0, 0.0]
    assert graph.vertices.where(F.col("v") == "a").count() == 1
