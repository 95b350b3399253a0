from pyspark.sql import functions as F

from netlex.functions.stats import pearson
from netlex.operators import communities, dialogue, graph, null_models, nulls, ranks


def test_rewiring_keeps_degrees_and_moves_edges(spark):
    rows = sorted({(min(i, j), max(i, j)) for i in range(40) for j in ((i * 7 + 3) % 40, (i * 11 + 5) % 40) if i != j})
    pairs = spark.createDataFrame(rows, "a long, b long")
    out = [tuple(r) for r in nulls.rewire(pairs, 2, rounds=3).collect()]
    for rep in (0, 1):
        mine = [(a, b) for r, a, b in out if r == rep]
        assert len(mine) == len(set(mine)) == len(rows) and all(a < b for a, b in mine) and set(mine) != set(rows)
        deg = lambda e: sorted((n, sum(n in x for x in e)) for n in range(40))
        assert deg(mine) == deg(rows)


def test_star_stays(spark):
    pairs = spark.createDataFrame([(0, i) for i in range(1, 6)], "a long, b long")
    assert sorted(map(tuple, nulls.rewire(pairs, 1, rounds=2).select("a", "b").collect())) == [(0, i) for i in range(1, 6)]


def test_shuffles_and_summary(spark):
    labels = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(9)] + [(9, None)], "node long, label string")
    out = nulls.label_shuffle(labels, 3)
    assert {tuple(r) for r in out.groupBy("replicate", "label").count().collect()} == {(r, x, n) for r in range(3) for x, n in (("A", 5), ("B", 4))}
    samples = spark.createDataFrame([(float(i % 2),) for i in range(1999)], "value double")
    row = nulls.permutation_p(nulls.null_summary(samples, spark.createDataFrame([(2.0,)], "value double"), [])).first()
    assert (row["at_least"], row["p"]) == (0, 0.0005)
    assert nulls.verdicts(nulls.null_summary(samples, spark.createDataFrame([(2.0,)], "value double"), [])).first()["verdict"] == "broker"


def test_louvain_splits_a_barbell(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)], "a long, b long").withColumn("weight", F.lit(1))
    got = dict(map(tuple, communities.louvain(pairs, sweeps=4, levels=2).collect()))
    assert communities.modularity(graph.symmetrize(pairs), spark.createDataFrame(list(got.items()), "node long, comm long")).first()[0] > 0.1


def test_degenerate_correlations_are_null(spark):
    flat = spark.createDataFrame([(1.0, float(i), i) for i in range(4)], "x double, y double, z long")
    assert flat.agg(pearson("x", "y")).first()[0] is None and flat.limit(0).agg(pearson("x", "y")).first()[0] is None
    assert abs(flat.agg(pearson("y", "z")).first()[0] - 1) < 1e-12
    assert ranks.spearman(flat, "x", "y").first()[0] is None and dialogue.partial_rank_corr(flat, "x", "y", "z").first()[0] is None
    triangle = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert graph.degree_assortativity(triangle).first()[0] is None


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, None, 2.0)], "v double")
    assert sorted((r.v, r.rank) for r in ranks.average_ranks(df, "v", "rank").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_statistics_of_copies(spark):
    """Two replicates: a triangle with a tail, and a path; node 5 stands alone."""
    rows = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 3, 4), (1, 1, 2), (1, 2, 3), (1, 3, 4)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    rewired = spark.createDataFrame(rows, "replicate int, a long, b long")
    got = {(r.replicate, r.statistic): r.value for r in null_models.statistics(rewired, nodes).collect()}
    assert got[0, "triangles"] == 1 and got[1, "triangles"] == 0 and got[0, "components"] == got[1, "components"] == 2
    assert got[0, "hub_share"] == 3 / 8 and abs(got[0, "clustering"] - (1 + 1 + 1 / 3) / 5) < 1e-12
    central = {(r.replicate, r.node, r.statistic): r.value for r in null_models.centralities(rewired, nodes).collect()}
    assert abs(central[1, 2, "betweenness"] - 4 / 12) < 1e-12 and abs(central[0, 3, "closeness"] - 9 / (3 * 4)) < 1e-12
    assert central[1, 5, "closeness"] == 0
    real = spark.createDataFrame([(a, b) for r, a, b in rows if r == 0], "a long, b long")
    found = {r.statistic: r for r in null_models.clique_null(real, nodes, 2, 3).collect()}
    assert found["cliques"].real == 1 and found["largest"].real == 3
    summary = null_models.centrality_null(real, nodes, 3)
    assert summary.count() == 10 and {r.list for r in null_models.broker_lists(summary, graph.degrees(graph.symmetrize(real), nodes)).collect()} <= {"brokers", "gatekeepers", "bottom"}


def test_directed_rewiring_keeps_both_degrees(spark):
    arcs = sorted({(i, (i * 7 + 3) % 30) for i in range(30)} | {(i, (i * 11 + 5) % 30) for i in range(30)})
    arcs = [(a, b) for a, b in arcs if a != b]
    out = [tuple(r) for r in nulls.rewire(spark.createDataFrame(arcs, "a long, b long"), 1, rounds=3, directed=True).select("a", "b").collect()]
    assert len(set(out)) == len(arcs) and set(out) != set(arcs) and all(a != b for a, b in out)
    assert sorted(a for a, _ in out) == sorted(a for a, _ in arcs) and sorted(b for _, b in out) == sorted(b for _, b in arcs)


def test_rewiring_keeps_degrees_of_edges_that_stand_twice(spark):
    arcs = [(i, (i * 7 + 3) % 30) for i in range(30) if i != (i * 7 + 3) % 30] + [(i, i + 1) for i in range(12)] * 4
    out = [tuple(r) for r in nulls.rewire(spark.createDataFrame(arcs, "a long, b long"), 2, rounds=6, directed=True).collect()]
    for rep in (0, 1):
        mine = [(a, b) for r, a, b in out if r == rep]
        assert sorted(a for a, _ in mine) == sorted(a for a, _ in arcs) and sorted(b for _, b in mine) == sorted(b for _, b in arcs)


def test_shuffled_assortativity_in_waves(spark):
    """Agrees with the plain way, also over several waves; unlabelled ends count in neither."""
    labels = spark.createDataFrame([(i, "ABC"[i % 3] if i % 7 else None) for i in range(40)], "node long, label string")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in (i + 1, i + 5) if j < 40], "a long, b long")
    want = dict(map(tuple, communities.attribute_assortativity(pairs, nulls.label_shuffle(labels, 150), ("replicate",)).collect()))
    for wave in (140 * 34, 1 << 20):
        got = dict(map(tuple, nulls.shuffled_assortativity(pairs, labels, 150, wave=wave).collect()))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
