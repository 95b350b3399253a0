"""Searches in tasks that hold the graph, against plain search; that nothing is shuffled or kept by level."""

import random
from collections import deque

import numpy as np
import pytest

from netlex.operators import flow, held, null_models, nulls, traverse
from tests.test_flow import brandes


def chain_and_crowd(seed=3):
    """Directed: a long chain (many levels of few), a crowd (few levels of many), a way from one to the other, a pair apart."""
    rng = random.Random(seed)
    links = {(i, i + 1) for i in range(40)} | {(40, 50)} | {(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(600)} | {(130, 131)}
    return sorted((a, b) for a, b in links if a != b)


def plain(links, roots):
    near, out = {}, {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    for root in roots:
        dist, queue = {root: 0}, deque([root])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
        out |= {(root, y): d for y, d in dist.items()}
    return out


@pytest.mark.parametrize("push", [0, 12, 1 << 40])
def test_pushed_cells_and_whole_rows_agree(monkeypatch, push):
    monkeypatch.setattr(held, "PUSH", push)
    monkeypatch.setattr(held, "CHUNK", 64)
    links, roots = chain_and_crowd(), [*range(0, 120, 2), 130, 131, 140]
    graph = held.Arcs(*(np.array(x, np.int32) for x in zip(*links, strict=True)), np.array(roots, np.int32))
    total, squares, reached = held._dependencies(graph, graph.of(np.array(roots)))
    want = brandes(links, roots)
    assert set(graph.ids[reached]) == want.keys()
    for node, x, y in zip(graph.ids, total, squares, strict=True):
        assert (x, y) == pytest.approx(want.get(node, (0.0, 0.0)), abs=1e-9)


def test_searches_keep_no_level(spark, monkeypatch):
    links = chain_and_crowd()
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in links], "src string, dst string")
    starts = [*range(120), 130, 131, *range(140, 300)]
    roots = spark.createDataFrame([(f"n{i}",) for i in starts], "node string")
    for module, name in ((traverse, "_search"), (flow, "_wave")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("levels are shuffled"))
    want = {(f"n{a}", f"n{b}"): d for (a, b), d in plain(links, starts).items()}
    got = [tuple(r) for r in traverse.bfs(edges, roots).collect()]
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert {(r.root, r.node) for r in traverse.bfs(edges, roots, 2).collect()} == {p for p, d in want.items() if d <= 2}
    counts = traverse.reach_counts(edges, roots)
    for f in (traverse.distance_summary, traverse.eccentricity, lambda x: traverse.closeness(x, roots)):
        pairs, sums = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f(x).collect()) for x in (traverse.bfs(edges, roots), counts))
        assert pairs == sums
    sums = {r.node: (r.delta, r.squares) for r in flow.dependency_sums(edges, roots).collect()}
    brute = brandes(links, starts)
    assert sums.keys() == {f"n{i}" for i in brute} and all(sums[f"n{i}"] == pytest.approx(brute[i], abs=1e-9) for i in brute)


def test_bits():
    rng = np.random.default_rng(1)
    for bits in (rng.integers(0, 2**63, (5, 3), np.uint64), (np.uint64(1) << rng.integers(0, 64, (5, 3)).astype(np.uint64)) * rng.integers(0, 2, (5, 3)).astype(np.uint64)):
        want = [(i, 64 * j + k) for i in range(5) for j in range(3) for k in range(64) if int(bits[i, j]) >> k & 1]
        assert sorted(zip(*map(list, held._set_bits(bits)), strict=True)) == want


def test_rewired_in_a_task():
    rng = random.Random(2)
    edges = np.array(sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)}))
    degrees = lambda a, b: np.bincount(np.concatenate([a, b]), minlength=60).tolist()
    a, b = nulls.swapped(edges[:, 0], edges[:, 1], 20, 5, False)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(got) == len(edges) and (a < b).all() and degrees(a, b) == degrees(*edges.T) and len(got & set(map(tuple, edges.tolist()))) < len(edges) / 2
    # The draw depends on edges and salt, not on the order of rows.
    order = rng.sample(range(len(edges)), len(edges))
    assert got == {(int(x), int(y)) for x, y in zip(*nulls.swapped(edges[order, 0], edges[order, 1], 20, 5, False), strict=True)}
    assert got != {(int(x), int(y)) for x, y in zip(*nulls.swapped(edges[:, 0], edges[:, 1], 20, 6, False), strict=True)}


def test_measures_in_a_task_agree_with_shuffles(spark, monkeypatch):
    rng = random.Random(4)
    crowd = {(r, *sorted(rng.sample(range(30 * r, 30 * r + 14), 2))) for r in (0, 1) for _ in range(55)}
    rows = sorted({(r, a % 30, b % 30) for r, a, b in crowd}) + [(0, 20, 21), (1, 20, 22)]
    rewired, nodes = spark.createDataFrame(rows, "replicate int, a long, b long"), spark.range(25).withColumnRenamed("id", "node")
    real = spark.createDataFrame([(a, b) for r, a, b in rows if not r], "a long, b long")
    monkeypatch.setattr(null_models, "rewire", lambda pairs, replicates, seed: rewired)
    cells = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    found = []
    for most in (held.HELD, 0):
        monkeypatch.setattr(held, "HELD", most)
        found.append([cells(f) for f in (null_models.statistics(rewired, nodes), null_models.centralities(rewired, nodes), null_models.clique_null(real, nodes, 2, 4))])
    assert found[0] == found[1] and all(found[0])


def test_centrality_nulls_rewire_200_times(spark, monkeypatch, tmp_path):
    from netlex.plans import registry

    seen = []

    def rewire(pairs, replicates, **_):
        seen.append(replicates)
        raise StopIteration

    monkeypatch.setattr(null_models, "rewire", rewire)
    events = spark.createDataFrame([(i, 0, i % 5, "purchase") for i in range(20)], "event_id long, t int, user_id long, event_type string")
    events.selectExpr("event_id", "timestamp_seconds(t) as ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("centrality_null", "broker_lists", "verdict_counts"):
        with pytest.raises(StopIteration):
            registry.QUERIES[name](spark, str(tmp_path))
    assert seen == [200] * 3
