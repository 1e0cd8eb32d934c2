"""Nearest neighbours, ranked where they are found."""

import numpy as np

from bispace.operators.neighbours import exclusion_knn


def test_lists_are_ranked_without_a_shuffle(spark):
    draw = np.random.default_rng(3)
    x, groups = draw.integers(0, 4, (150, 3)).astype(float), draw.integers(0, 40, (150, 2))
    rows = [(i, int(a), int(b), v.tolist()) for i, (v, (a, b)) in enumerate(zip(x, groups, strict=True))]
    rows += [(200, 1000, 1000, [float("nan"), 0.0, 0.0]), (201, 1001, 1001, [float("inf"), 0.0, 0.0])]
    nodes = spark.createDataFrame(rows, "id long, ag long, bg long, v array<double>")
    found = exclusion_knn(nodes, "v", 40, block=16)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i in range(150):
        near = sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 9), j) for j in range(150) if (groups[i] != groups[j]).all())[:40]
        want |= {(i, j, d, k) for k, (d, j) in enumerate(near, 1)}
    assert {(r.src, r.dst, r.dist, r.rank) for r in found.collect()} == want
