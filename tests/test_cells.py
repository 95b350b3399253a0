"""Threshold sweeps over cells of scores against plain merging."""

import random

import pytest

from netlex.operators import held, sweep

GRID = [0.5, 2.0, 1.0, 1.0, 9.0, 3.25]


def plain(rows, t):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, s in rows:
        if a != b and s < t:
            parent[find(a)] = find(b)
    sizes = {}
    for x in list(parent):
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    return sum(a != b and s < t for a, b, s in rows), max(sizes.values(), default=0)


@pytest.mark.parametrize("most,whole", [(1 << 21, 1 << 24), (40, 1 << 24), (5, 10)])
def test_sweep_by_cells(spark, monkeypatch, most, whole):
    rng = random.Random(most)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(40) / 4) for _ in range(110)]
    rows = [(min(a, b), max(a, b), s) for a, b, s in rows]
    monkeypatch.setattr(sweep, "FOREST", most)
    monkeypatch.setattr(held, "HELD", whole)
    monkeypatch.setattr(sweep, "spanning_forest", lambda *a: pytest.fail("a forest of all scores"))
    scored = spark.createDataFrame(rows, "a long, b long, score double")
    want = sorted((t, *plain(rows, t)) for t in GRID)
    assert sorted(tuple(r) for r in sweep.threshold_sweep(scored, GRID).collect()) == want
    assert sorted(tuple(r) for r in sweep.threshold_edges(scored, GRID).collect()) == [(t, n) for t, n, _ in want]
    assert [r.giant for r in sweep.threshold_sweep(scored.limit(0), [1.0]).collect()] == [0]
