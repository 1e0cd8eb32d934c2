"""Sums over neighbourhoods of wide features, and the tests built on them, against plain matrices."""

import numpy as np
from pyspark.sql import functions as F

from bispace.operators import graph_tests, wide


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(parts)


def test_blocked_sums_equal_a_matrix_product(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(-3, 4, (90, 70)).astype(float)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 95, (600, 2))] + [(3, 4), (3, 4)]  # five ids without features
    rows = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    a = np.zeros((95, 90))
    for s, d in edges:
        if d < 90:
            a[s, d] += 1
    packed = table(spark, x).withColumn("y", F.transform("x", lambda v: v * v))
    got = wide.neighbour_sums(rows, packed, ["x", "y"], rows=16, width=32).collect()
    assert {r.part for r in got} == {0, 1, 2} and {r.id for r in got} == set(np.flatnonzero(a.sum(1)).tolist())
    for r in got:
        part = slice(32 * r.part, 32 * r.part + 32)
        assert r.n == a[r.id].sum()
        assert np.allclose(r.x, (a[r.id] @ x)[part]) and np.allclose(r.y, (a[r.id] @ (x * x))[part])
    assert wide.neighbour_sums(rows.limit(0), packed, ["x"]).count() == 0
    assert wide.neighbour_sums(rows, packed.limit(0), ["x"]).count() == 0


def test_plans_do_not_grow_with_the_features(spark):
    edges = spark.createDataFrame([(i, (i + k) % 40, float(k), k) for i in range(40) for k in (1, 2, 3)], "src long, dst long, dist double, rank int")
    draw, size = np.random.default_rng(2), []
    for width in (5, 2500):
        x = draw.normal(size=(40, width))
        x[:10, 1] += 5
        names = [f"f{k}" for k in range(width)]
        tests = graph_tests.neighbourhood_tests(edges, table(spark, x), width)
        hot = graph_tests.hotspot_packed(edges, table(spark, x), names)
        size.append(len(tests._jdf.queryExecution().toString()) + len(hot._jdf.queryExecution().toString()))
        found = {r.feature: r.z for r in hot.collect()}
        a = np.zeros((40, 40))
        for i in range(40):
            a[i, [(i + k) % 40 for k in (1, 2, 3)]] = 1
        v = sum(2 if a[j, i] else 1 for i, j in zip(*np.nonzero(a), strict=True))
        z = ((x * (a @ x)).sum(0) - x.mean(0) * (a @ x).sum(0)) / x.var(0) / np.sqrt(v)
        assert np.allclose([found[n] for n in names], z)
    assert size[1] < 1.2 * size[0]


def test_relabelled_overlaps_by_bits_and_by_joins(spark):
    draw = np.random.default_rng(3)
    ids = [3 * k + 1 for k in range(530)]  # more than one block of rows
    pick = lambda m: spark.createDataFrame(list({(ids[a], ids[b]) for a, b in draw.integers(0, 530, (m, 2)) if a != b}), "src long, dst long")
    a, b, nodes = pick(4000), pick(3000), spark.createDataFrame([(i,) for i in ids], "id long")
    perm = graph_tests.shuffles(nodes, 7).cache()
    to = {(r.rep, r.id): r.to for r in perm.collect()}
    assert all(sorted(to[rep, i] for i in ids) == ids for rep in range(1, 8))
    mine, other = {tuple(r) for r in a.collect()}, [tuple(r) for r in b.collect()]
    want = {rep: sum((to[rep, s], to[rep, d]) in mine for s, d in other) for rep in range(1, 8)}
    for most in (64 << 20, 0):
        got = {r.rep: r.k for r in graph_tests.relabelled_overlaps(a, b, nodes, perm, 7, most).collect()}
        assert {rep: got.get(rep, 0) for rep in want} == want


def test_random_threshold_does_not_depend_on_partitions(spark):
    edges = spark.createDataFrame([(i, (i + k) % 60) for i in range(60) for k in (1, 2, 3)], "src long, dst long")
    nodes = spark.range(60)
    found = {round(graph_tests.random_threshold(edges.repartition(k), nodes.repartition(k), 20), 12) for k in (2, 5)}
    assert len(found) == 1 and 0.5 < found.pop() < 3
    assert graph_tests.random_threshold(edges.limit(0), nodes, 20) == float("inf")
