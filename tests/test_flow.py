"""Sums of dependencies against Brandes' algorithm in plain Python."""

from collections import deque

import pytest

from netlex.operators import flow, null_models, traverse


def brandes(links, roots):
    near, sums = {}, {}
    for a, b in links:
        near.setdefault(a, []).append(b)
    for root in roots:
        dist, sigma, order, queue = {root: 0}, {root: 1.0}, [], deque([root])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near.get(x, ()):
                if y not in dist:
                    dist[y], sigma[y] = dist[x] + 1, 0.0
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(order, 0.0)
        for x in reversed(order):
            delta[x] += sum(sigma[x] / sigma[y] * (1 + delta[y]) for y in near.get(x, ()) if dist[y] == dist[x] + 1)
            if x != root:
                s, q = sums.get(x, (0.0, 0.0))
                sums[x] = (s + delta[x], q + delta[x] ** 2)
    return sums


def test_dependencies_share_rows_and_tiles(spark, monkeypatch):
    # Directed, two blocks of roots, tiles of some 60 edges and a hub with more; a bound of waves that takes a block at a time.
    links = {(i, (i * 3 + k) % 140) for i in range(140) for k in (1, 5)} | {(i, 7) for i in range(0, 140, 2)} | {(7, 3), (147, 148)}
    links = {(a, b) for a, b in links if a != b}
    held, settle = [], flow.settle
    monkeypatch.setattr(flow, "settle", lambda df: held.append(settle(df)) or held[-1])
    monkeypatch.setattr(flow, "TILE", 60)
    monkeypatch.setattr(flow, "WAVE", 1)
    edges, roots = spark.createDataFrame(sorted(links), "src long, dst long"), spark.range(150).withColumnRenamed("id", "node")
    got = {r.node: (r.delta, r.squares) for r in flow.dependency_sums(edges, roots).collect()}
    want = brandes(links, range(150))
    assert got.keys() == want.keys() and len(want) > 100
    for node, pair in want.items():
        assert got[node] == pytest.approx(pair, abs=1e-9)
    # Rows with values that a level holds are for a block of roots and a node, not for each pair (thousands here).
    assert max(df.filter("value is not null").count() for df in held if "value" in df.columns and "tile" not in df.columns) <= 150
    assert len({r.tile for df in held if df.columns == ["tile", "at", "value"] for r in df.collect()}) > 3


def test_null_models_need_no_row_for_a_pair(spark, monkeypatch):
    # 70 roots, two blocks of bits: a path of 0 to 66, a pair, a lone node; distances are counted, pairs are not told apart.
    links = [(i, i + 1) for i in range(66)] + [(67, 68)]
    monkeypatch.setattr(traverse, "bfs", lambda *a: pytest.fail("a row for each pair"))
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "src long, dst long")
    nodes = spark.range(70).withColumnRenamed("id", "node")
    got = {(r.node, r.dist): r.n for r in traverse.distance_counts(edges, nodes).collect()}
    want = {}
    for i in range(67):
        for j in range(67):
            want[i, abs(i - j)] = want.get((i, abs(i - j)), 0) + 1
    assert got == want | {(67, 0): 1, (67, 1): 1, (68, 0): 1, (68, 1): 1, (69, 0): 1}
    graphs = spark.createDataFrame([(0, *p) for p in links], "replicate int, a long, b long")
    found = {r.statistic: r.value for r in null_models.shapes(graphs, nodes).collect()}
    pairs = [abs(i - j) for i in range(67) for j in range(67) if i != j] + [1, 1]
    assert found["path_length"] == pytest.approx(sum(pairs) / len(pairs))
