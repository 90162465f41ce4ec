from __future__ import annotations

import random
from collections import defaultdict, deque
from itertools import combinations

import pytest

from orgweft.operators import graph as G


def make(seed, n=14, p=0.2):
    rng = random.Random(seed)
    names = [f"v{i:02d}" for i in range(n)]
    return names, [pair for pair in combinations(names, 2) if rng.random() < p]


def neighbours(names, pairs):
    out = {v: set() for v in names}
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def shortest(near, s):
    """Distance and all shortest paths from s."""
    dist, paths, queue = {s: 0}, defaultdict(list), deque([s])
    paths[s] = [(s,)]
    while queue:
        v = queue.popleft()
        for w in sorted(near[v]):
            if w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += [(*path, w) for path in paths[v]]
    return dist, paths


def frames(spark, names, pairs):
    arcs = spark.createDataFrame(pairs, "src STRING, dst STRING")
    return G.build_graph(arcs, spark.createDataFrame([(v,) for v in names], "v STRING"))


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    """The same results by broadcast arcs and by salted, shuffled arcs."""
    if not small:
        monkeypatch.setattr(G, "BROADCAST_ARCS", 0)
        monkeypatch.setattr(G, "ARCS_PER_SLOT", 2)
        monkeypatch.setattr(G, "BLOCK_ROWS", 70)
        monkeypatch.setattr(G, "LEVELS_PER_JOB", 1)
    names, pairs = make(3)
    near = neighbours(names, pairs)
    graph = frames(spark, names, pairs)
    assert graph.small is small
    walks = {s: shortest(near, s) for s in names}
    expected = dict.fromkeys(names, 0.0)
    bounded = dict.fromkeys(names, 0.0)
    reached = 0
    for s, t in combinations(names, 2):
        dist, paths = walks[s]
        if t not in dist:
            continue
        reached += dist[t] <= 2
        for path in paths[t]:
            for v in path[1:-1]:
                expected[v] += 1 / len(paths[t])
                bounded[v] += (1 / len(paths[t])) if dist[t] <= 2 else 0
    n = len(names)
    got = {r["v"]: r["centrality"] for r in G.betweenness_exact(graph).collect()}
    assert got == pytest.approx({v: 2 * x / ((n - 1) * (n - 2)) for v, x in expected.items()})
    got = {r["v"]: r["centrality"] for r in G.betweenness_bounded(graph, G.all_sources(graph), 2).collect()}
    assert got == pytest.approx({v: x / reached for v, x in bounded.items()})
    assert G.reachable_pairs(graph, 2).first()["pairs"] == reached

    asked = spark.createDataFrame([(s, t) for s in names[:3] for t in names], "a STRING, b STRING")
    for row in G.first_bridges(graph, asked, 4).collect():
        dist, paths = walks[row["a"]]
        want = min(paths[row["b"]]) if dist.get(row["b"], 9) <= 4 else None
        assert (tuple(row["path"]) if row["path"] else None) == want
    every = defaultdict(set)
    for row in G.all_shortest_paths(graph, asked, 3).collect():
        every[row["a"], row["b"]].add(tuple(row["path"]))
    for s in names[:3]:
        dist, paths = walks[s]
        for t in names:
            assert every[s, t] == (set(paths[t]) if dist.get(t, 9) <= 3 else set())
    for row in G.pair_distances(graph, asked, 3).collect():
        d = walks[row["a"]][0].get(row["b"], 9)
        assert row["distance"] == (d if d <= 3 else None)


def test_components(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    star = [("hub", f"leaf{i}") for i in range(10)]
    vertices = sorted({v for pair in chain + star for v in pair} | {"alone"})
    found = G.connected_components(
        spark.createDataFrame([(v,) for v in vertices], "v STRING"),
        spark.createDataFrame(chain + star, "a STRING, b STRING"),
    )
    got = {r["v"]: r["component"] for r in found.collect()}
    assert {got[f"c{i:02d}"] for i in range(21)} == {"c00"}
    assert {got[f"leaf{i}"] for i in range(10)} == {"hub"} and got["alone"] == "alone"


def test_sampled_pairs(spark):
    names, pairs = make(5, n=12)
    graph = frames(spark, names, pairs)
    once = {tuple(sorted(r)) for r in G.sampled_pairs(graph, 1, 20).collect()}
    again = {tuple(sorted(r)) for r in G.sampled_pairs(graph, 1, 20).collect()}
    every = {tuple(sorted(r)) for r in G.sampled_pairs(graph, 1, 500).collect()}
    assert once == again and len(once) == 20 and every == set(combinations(names, 2))


def test_removed_people(spark):
    graph = frames(spark, list("abcde"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])
    removed = spark.createDataFrame([("b",), ("c",)], "g STRING")
    got = {r["g"]: r["pairs"] for r in G.reachable_pairs(graph, 4, removed).collect()}
    assert got == {"b": 3, "c": 2}


@pytest.mark.parametrize("words", [50_000, 1])
def test_more_sources_than_a_word_holds(spark, monkeypatch, words):
    """Bits of several words, walked together or one after the other."""
    monkeypatch.setattr(G, "WORDS_PER_WALK", words)
    names, pairs = make(8, n=150, p=0.012)
    near = neighbours(names, pairs)
    graph = frames(spark, names, pairs)
    walks = {s: shortest(near, s)[0] for s in names}
    some = names[::3]
    for bound in (1, 3):
        close = [(a, b) for a, b in combinations(names, 2) if walks[a].get(b, 99) <= bound]
        assert G.reachable_pairs(graph, bound).first()["pairs"] == len(close)
        ends = spark.createDataFrame([(v,) for v in some], "v STRING")
        expected = sum(a in some and b in some for a, b in close)
        assert G.reachable_pairs(graph, bound, endpoints=ends).first()["pairs"] == expected
    gone = ["v07", "v149", "v00"]
    removed = spark.createDataFrame([(g,) for g in [*gone, "nobody"]], "g STRING")
    got = {r["g"]: r["pairs"] for r in G.reachable_pairs(graph, 3, removed).collect()}
    for g in [*gone, "nobody"]:
        left = {v: near[v] - {g} for v in names if v != g}
        dist = {s: shortest(left, s)[0] for s in left}
        assert got[g] == sum(dist[a].get(b, 99) <= 3 for a, b in combinations(sorted(left), 2))
    asked = spark.createDataFrame([*combinations(names, 2), ("v03", "v03"), ("v03", "x"), ("x", "x")], "a STRING, b STRING")
    for bound in (1, 4, 5):
        rows = G.pair_distances(graph, asked, bound).collect()
        assert len(rows) == 150 * 149 // 2 + 3
        for row in rows:
            d = walks.get(row["a"], {}).get(row["b"], 99)
            assert row["distance"] == (d if d <= bound else None)


def test_sweep_of_bounds(spark):
    names, pairs = make(4, n=16, p=0.15)
    graph = frames(spark, names, pairs)
    got = {r["max_len"]: r for r in G.length_sweep(graph, range(1, 5), 3, 2).collect()}
    sources = G.all_sources(graph)
    for bound in range(1, 5):
        assert got[bound]["reachable_pairs"] == G.reachable_pairs(graph, bound).first()["pairs"]
        tally = {r["v"]: round(r["tally"], 6) for r in G.path_tallies(graph, sources, bound)[0].collect()}
        assert got[bound]["top_1"] == min(names, key=lambda v: (-tally.get(v, 0), v))
    assert got[2]["overlap"] == 1.0


def test_graph_without_arcs(spark):
    graph = G.build_graph(
        spark.createDataFrame([], "src STRING, dst STRING"), spark.createDataFrame([("a",), ("b",)], "v STRING")
    )
    asked = spark.createDataFrame([("a", "b")], "a STRING, b STRING")
    assert {r["v"]: r["centrality"] for r in G.betweenness_exact(graph).collect()} == {"a": 0.0, "b": 0.0}
    assert G.reachable_pairs(graph, 4).first()["pairs"] == 0
    assert G.pair_distances(graph, asked, 4).first()["distance"] is None
    assert G.first_bridges(graph, asked, 4).first()["path"] is None
    assert G.all_shortest_paths(graph, asked, 4).collect() == []
