"""The fit of the quality rules runs in the driver: what it holds at once."""

import tracemalloc

import numpy as np

from netlex.llm import quality


def test_fit_holds_its_matrix_twice_at_most():
    g = np.random.default_rng(1)
    x = np.round(g.normal(size=(6000, len(quality.STATISTICS))), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + g.normal(size=len(x)) > 0).astype(float)
    matrices, norm = [], np.linalg.norm
    np.linalg.norm = lambda z, *a: matrices.append(z.nbytes) or norm(z, *a)
    tracemalloc.start()
    try:
        quality.fit(x, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        np.linalg.norm = norm
        tracemalloc.stop()
    print(peak / matrices[0])
    assert peak < 2.3 * matrices[0]
