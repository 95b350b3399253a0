"""Hand-made graphs with answers worked out independently."""

import pytest
from pyspark.sql import functions as F

from netlex.operators import cliques, communities, graph, ranks, spectral, sweep, traverse


@pytest.fixture(scope="module")
def kite(spark):
    rows = [(1, 2), (2, 1), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 4), (5, 5), (5, 99)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node long")
    edges = graph.clean_edges(spark.createDataFrame(rows, "src long, dst long"), nodes)
    return edges, graph.undirect(edges), nodes


@pytest.fixture(scope="module")
def barbell(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)], "a long, b long")
    return pairs, spark.createDataFrame([(i,) for i in range(1, 7)], "node long")


def values(df, *columns):
    return {r[0]: r[1] if len(columns) == 2 else tuple(r[1:]) for r in df.select(*columns).collect()}


def test_kite_degrees_and_triangles(kite):
    edges, pairs, nodes = kite
    assert values(graph.degrees(edges, nodes), "node", "deg") == {1: 2, 2: 3, 3: 3, 4: 3, 5: 1, 6: 0}
    per = graph.triangles_per_node(pairs, nodes)
    assert values(per, "node", "tri") == {1: 1, 2: 2, 3: 2, 4: 1, 5: 0, 6: 0}
    row = graph.clustering_summary(per).first()
    assert (row["avg_clustering"], row["transitivity"], row["triangles"]) == pytest.approx((0.4444444444, 0.6, 2))
    assert graph.degree_assortativity(pairs).first()[0] == pytest.approx(-0.2857142857)


def test_kite_distances(kite):
    _, pairs, nodes = kite
    assert values(traverse.component_sizes(pairs, nodes), "node", "comp") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
    inside = traverse.giant(pairs, nodes)
    sym = graph.symmetrize(pairs)
    dist = traverse.bfs(sym, inside)
    assert tuple(traverse.distance_summary(dist).first()) == (1.5, 3)
    between = values(traverse.betweenness(sym, inside), "node", "betweenness")
    assert [between[i] for i in range(1, 6)] == pytest.approx([0, 1 / 6, 1 / 6, 0.5, 0])
    close = values(traverse.closeness(dist, inside), "node", "closeness", "harmonic")
    assert [close[i][0] for i in range(1, 6)] == pytest.approx([4 / 7, 0.8, 0.8, 0.8, 0.5])
    _, value = spectral.eigenvector(sym, inside)
    assert value == pytest.approx(2.6411864762, abs=1e-8)


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    got = values(spectral.pagerank(edges, nodes, tol=1e-9), "node", "pagerank")
    assert [got[i] for i in range(1, 6)] == pytest.approx([0.3590620, 0.1887459, 0.3799029, 0.0361446, 0.0361446], abs=1e-6)
    assert graph.reciprocity(edges).first()[0] == pytest.approx(0.4)


def test_barbell_cliques_and_communities(spark, barbell):
    pairs, _ = barbell
    found = sorted(tuple(r["clique"]) for r in cliques.maximal_cliques(pairs, 3).collect())
    assert found == [(1, 2, 3), (4, 5, 6)]
    comms = {}
    for r in cliques.k_clique_communities(pairs, 3).collect():
        comms.setdefault(r["comm"], set()).add(r["node"])
    assert sorted(map(sorted, comms.values())) == [[1, 2, 3], [4, 5, 6]]
    labels = spark.createDataFrame([(i, "A" if i < 4 else "B") for i in range(1, 7)], "node long, label string")
    assert communities.attribute_assortativity(pairs, labels).first()[0] == pytest.approx(5 / 7)


def test_weighted_backbone(spark):
    pairs = spark.createDataFrame([("a", "b", 10), ("a", "c", 1), ("a", "d", 1), ("b", "c", 1), ("c", "d", 5)], "a string, b string, weight long")
    alpha = {(r.a, r.b): r.alpha for r in sweep.disparity_alpha(pairs).collect()}
    assert alpha == pytest.approx({("a", "b"): 0.0277778, ("c", "d"): 0.0816327, ("a", "c"): 0.7346939, ("b", "c"): 0.7346939, ("a", "d"): 0.8333333}, abs=1e-6)
    scored = sweep.disparity_alpha(pairs).select("a", "b", F.round("alpha", 6).alias("score"))
    events = [(r.a, r.b, r.size_a, r.size_b) for r in sweep.merge_events(scored).orderBy("score", "a", "b").collect()]
    assert events == [("a", "b", 1, 1), ("c", "d", 1, 1), ("a", "c", 2, 2)]
    assert [tuple(r) for r in sweep.threshold_sweep(scored, [0.1]).collect()] == [(0.1, 2, 2)]


def test_partitions(spark):
    part = spark.createDataFrame([(i, "AAABBB"[i], "xxyyyy"[i]) for i in range(6)], "node long, p string, q string")
    assert communities.nmi(part, "p", "q").first()[0] == pytest.approx(0.4787039714)
    assert dict(map(tuple, communities.best_alignment(part, "p", "q").collect())) == {"A": "x", "B": "y"}
    assert communities.movers(part, "p", "q").count() == 1


def test_ordinals_hold_under_any_partitioning(spark):
    for n in (1, 7):
        df = spark.range(0, 1000, 1, n).select((F.col("id") * 7919 % 1000).alias("x"))
        rows = ranks.row_ordinals(df, ["x"], "i").collect()
        assert all(r["x"] == r["i"] for r in rows) and len(rows) == 1000


def test_empty_graph(spark):
    pairs = spark.createDataFrame([], "a long, b long")
    nodes = spark.createDataFrame([], "node long")
    assert traverse.component_sizes(pairs, nodes).count() == 0
    assert graph.triangles_per_node(pairs, nodes).count() == 0
    assert graph.degree_assortativity(pairs).first()[0] is None


def test_percolation_of_a_long_chain(spark):
    # Each clique of four shares three nodes with the next: one community, many more links long than ten.
    chain = cliques.k_clique_communities(spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, min(i + 4, 40))], "a long, b long"), 4)
    counts = cliques.overlap_counts(chain, spark.range(41).withColumnRenamed("id", "node"), [4])
    assert {tuple(r) for r in counts.collect()} == {(i, 1) for i in range(40)} | {(40, 0)}


def test_search_from_many_roots_shares_rows(spark, monkeypatch):
    # 150 roots, three blocks of bits: a ring with chords, a loose pair, a lone node; against plain search.
    links = {(i, (i + 1) % 140) for i in range(140)} | {(i, (i * 7 + 3) % 140) for i in range(0, 140, 9)} | {(147, 148)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
    want = set()
    for root in range(150):
        dist, level = {root: 0}, [root]
        while level:
            level = [y for x in level for y in near.get(x, ()) if y not in dist and dist.update({y: dist[x] + 1}) is None]
        want |= {(root, node, d) for node, d in dist.items()}
    held, settle = [], traverse.settle
    monkeypatch.setattr(traverse, "settle", lambda df: held.append(settle(df)) or held[-1])
    edges, roots = spark.createDataFrame(sorted(links), "src long, dst long"), spark.range(150).withColumnRenamed("id", "node")
    got = traverse.bfs(edges, roots)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # What a level joins and shuffles has a row for each block of roots and node, not for each pair.
    states = [df.count() for df in held if "old" in df.columns]
    assert states and max(states) <= 3 * 150
    assert sorted(map(tuple, traverse.bfs(edges, roots, 2).collect())) == sorted(r for r in want if r[2] <= 2)
