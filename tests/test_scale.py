"""Operators made for large inputs against plain ones: range replays, long chains, sketches, bounded sampling, sparse pair ranks."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from netlex.operators import cliques, dialogue, graph, nulls, sketches, sweep, traverse


def random_pairs(spark, n, m, seed):
    rng = random.Random(seed)
    rows = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return spark.createDataFrame([(a, b, rng.randrange(12) / 4) for a, b in sorted(rows)], "a long, b long, score double"), sorted(rows)


def plain_merges(rows):
    size, parent, out = {}, {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in sorted((r.score, r.a, r.b) for r in rows):
        x, y = find(a), find(b)
        if x != y:
            n, m = size.get(x, 1), size.get(y, 1)
            out.append((a, b, s, n, m, min(n, m)))
            parent[y], size[x] = x, n + m
    return out


@pytest.mark.parametrize("most", [100_000, 7])
def test_merges_by_ranges(spark, most):
    scored, _ = random_pairs(spark, 90, 160, 3)
    got = sorted(tuple(r) for r in sweep.merge_events(scored, most).collect())
    assert got == sorted(plain_merges(scored.collect()))
    assert sweep.merge_events(scored.limit(0), most).count() == 0


def plain_families(found, similarity):
    order = sorted((sorted(c) for c in found), key=lambda c: (-len(c), c))
    families = []
    for c in order:
        for lineup, held in families:
            if len(set(c) & set(lineup)) >= similarity * len(set(c) | set(lineup)) - 1e-12:
                held.append(c)
                break
        else:
            families.append((c, [c]))
    return sorted((x, len(x), len(held), sorted({m for c in held for m in c} - set(x)), sorted({m for c in held for m in c})) for x, held in families)


@pytest.mark.parametrize("most", [100_000, 3])
def test_families_of_long_chains(spark, most):
    n = 130 if most > 3 else 24
    chain = [[2 * i + k for k in range(8)] for i in range(n)]
    rng = random.Random(4)
    others = [sorted(rng.sample(range(1000, 1016), rng.randrange(3, 7))) for _ in range(30)]
    found = [list(x) for x in {tuple(c) for c in chain + others}]
    df = spark.createDataFrame([(c,) for c in found], "clique array<long>")
    got = sorted((r.lineup, r["size"], r.variants, r.swaps, r.members) for r in cliques.clique_families(df, most=most).collect())
    assert got == plain_families(found, 0.6) and sum(g[2] for g in got) == len(found)


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(i, 100 + i) for i in range(10)], "src long, dst long")
    row = traverse.shortest_path(edges, 0, 70).first()
    assert row.path == list(range(71)) and row.reached == 81
    assert traverse.shortest_path(edges, 70, 0).first().path is None


def test_sketches(spark):
    pairs, _ = random_pairs(spark, 400, 900, 5)
    sym, nodes = graph.symmetrize(pairs.select("a", "b")), spark.range(400).withColumnRenamed("id", "node")
    dist = traverse.bfs(sym, nodes)
    exact = {r.node: (r.closeness, r.harmonic) for r in traverse.closeness(dist, nodes).collect()}
    got = {r.node: (r.closeness, r.harmonic) for r in sketches.sketched_closeness(sym, nodes, 128).collect()}
    assert set(got) == set(exact)
    off = [abs(got[i][1] - exact[i][1]) / exact[i][1] for i in exact if exact[i][1]]
    # The standard error of one count is 1.04 / sqrt(128) = 9 %.
    assert sum(off) / len(off) < 0.14 and max(off) < 0.45
    path, short = traverse.distance_summary(dist).first(), sketches.sketched_summary(sym, nodes, 128).first()
    assert abs(short.avg_path - path.avg_path) / path.avg_path < 0.05 and path.diameter - 2 <= short.diameter <= path.diameter
    # Isolated nodes reach nothing.
    alone = [i for i in exact if exact[i] == (0.0, 0.0)]
    assert alone and all(got[i] == (0.0, 0.0) for i in alone)


def test_betweenness_within_its_bound(spark):
    pairs, _ = random_pairs(spark, 120, 300, 6)
    sym, nodes = graph.symmetrize(pairs.select("a", "b")), spark.range(120).withColumnRenamed("id", "node")
    exact = {r.node: r.betweenness for r in traverse.betweenness(sym, nodes).collect()}
    for error in (0.0, 0.8):
        rows = traverse.betweenness_within(sym, nodes, error=error, batch=16).collect()
        assert len(rows) == 120 and all(abs(r.betweenness - exact[r.node]) <= r.error + 1e-9 for r in rows)
        assert {r.sources for r in rows} == {120} if not error else max(r.sources for r in rows) < 120


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def corr(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sxy, sxx, syy = (sum((a - p) * (b - q) for a, b in zip(u, v, strict=True)) for u, v, p, q in ((x, y, mx, my), (x, x, mx, mx), (y, y, my, my)))
    return sxy / math.sqrt(sxx * syy)


def test_sparse_pair_correlations(spark):
    rng = random.Random(7)
    pairs = list(itertools.combinations(range(9), 2))
    tables = [{p: rng.choice([-2.0, -1.0, 1.0, 1.0, 3.0, 0.0]) for p in rng.sample(pairs, 20)} for _ in range(2)]
    frames = [spark.createDataFrame([(a, b, v) for (a, b), v in t.items()], "a long, b long, value double") for t in tables]
    nodes = spark.range(9).withColumnRenamed("id", "node")
    want = corr(*(ranks([t.get(p, 0.0) for p in pairs]) for t in tables))
    got = nulls.pair_correlations({"x": frames[0]}, {"y": frames[1], "x": frames[0]}, nodes).collect()
    assert {r.y: round(r.value, 9) for r in got} == {"y": round(want, 9), "x": 1.0}
    row = nulls.mantel_tests({"x": frames[0]}, {"x": frames[0]}, nodes, 99).first()
    assert row.n == 99 and row.real == 1.0 and row.p <= 0.05
    row = nulls.mantel(frames[0], frames[1], 99, nodes=nodes).first()
    assert round(row.real, 9) == round(want, 9) and row.n == 99


def test_heaps_and_stages(spark):
    rng = random.Random(8)
    data = [("c", i, rng.choice(["a", "b", None]), " ".join(rng.choice(["The", "cat’s", "um", "[dog barks]", "Runs,", "x1y", "far"]) for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    lines = spark.createDataFrame(data + [("d", 99, "e", "[only this]")], "conv_id string, pos long, speaker string, text string").repartition(4)
    spoken = {}
    import re

    tok = lambda t: re.findall(r"[a-z]+(?:'[a-z]+)?", t.lower().replace("’", "'"))
    for _, _, s, t in data:
        spoken.setdefault(s, []).extend(tok(t))
    want = set()
    for s, terms in [*spoken.items(), ("e", tok("[only this]"))]:
        n = len(terms)
        grid = {math.floor(10 ** (1 + k * (math.log10(n) - 1) / 39)) for k in range(39)}
        want |= {(s, i, len(set(terms[:i]))) for i in {x for x in grid if x < n} | {n}}
    assert {tuple(r) for r in dialogue.heaps_curve(lines).collect()} == want
    text = [t for *_, t in data] + ["[only this]"]
    clean = [re.sub(r"\s+", " ", re.sub(r"\[[^\]]*\]", " ", t)).strip() for t in text]
    stages = [sum((t.split() for t in text), []), sum((t.lower().split() for t in text), []), sum(map(tok, text), []), sum(map(tok, clean), [])]
    stages.append([t for t in stages[3] if t not in dialogue.STOP])
    stages.append([t for t in stages[4] if t not in dialogue.FILLER])
    assert sorted(tuple(r) for r in dialogue.stage_counts(lines).collect()) == [(i, len(s), len(set(s))) for i, s in enumerate(stages) if s]
    assert dialogue.stage_counts(spark.createDataFrame([("c", 1, "s", "[A b] Hello [c] THE hello, um")], lines.schema)).count() == 6


def test_lift_without_strength(spark):
    pairs = spark.createDataFrame([("a", "b", 0), ("c", "d", 2)], "a string, b string, weight long")
    assert {(r.a, r.lift) for r in dialogue.talk_lift(pairs).collect()} == {("a", None), ("c", 2.0)}
    core = spark.createDataFrame([("a",), ("b",)], "speaker string")
    assert dialogue.talk_lift(pairs, core).count() == 1


def test_concordance(spark):
    rows = [("c", i, f"s{i % 3}", t) for i, t in enumerate(["that’s what", "no", "THAT's what she", "that's what"])] + [("d", 1, "s", "that's what"), (None, 1, "n", "x"), (None, 2, "n", "that's what")]
    lines = spark.createDataFrame(rows, "conv_id string, pos long, speaker string, text string").repartition(3)
    got = {(r.conv_id, r.pos, r.before_speaker, r.before_text) for r in dialogue.concordance(lines, "that's what").collect()}
    assert got == {("c", 0, None, None), ("c", 2, "s1", "no"), ("c", 3, "s2", "THAT's what she"), ("d", 1, None, None), (None, 2, "n", "x")}
    assert {tuple(r) for r in dialogue.concordance_speakers(dialogue.concordance(lines, "that's what")).collect()} == {("s0", 2), ("s2", 1), ("s", 1), ("n", 1)}


def test_a_statistic_of_ones_own(spark):
    from netlex.operators import null_models

    pairs, _ = random_pairs(spark, 30, 60, 9)

    def leaves(graphs, nodes):
        ends = graphs.select("replicate", F.explode(F.array("a", "b")).alias("node")).groupBy("replicate", "node").agg(F.count("*").alias("deg"))
        return ends.groupBy("replicate").agg(F.count_if(F.col("deg") == 1).alias("value")).select("replicate", F.lit("leaves").alias("statistic"), "value")

    got = null_models.shuffle_test(pairs.select("a", "b"), spark.range(30).withColumnRenamed("id", "node"), replicates=5, measures=[leaves]).collect()
    # Rewires keep degrees, so the count does not change.
    assert [(r.statistic, r.real == r["mean"], r.n, r.outcome) for r in got] == [("leaves", True, 5, "invariant")]


def test_checkpoint_folder_is_asked_for():
    from netlex.functions.shared import shared_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())
