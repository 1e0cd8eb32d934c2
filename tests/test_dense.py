"""Graphs without edges: sums, counts and tests are those of the edge tables, ties included."""

import numpy as np

from bispace.operators import dense, graph_tests, neighbours


def made(spark, n=150):
    draw = np.random.default_rng(8)
    x, g = draw.integers(0, 4, (n, 3)).astype(float), draw.integers(0, 60, (n, 2))  # many equal distances
    x[4, 1] = np.inf
    rows = [(i, x[i].tolist() if i != 3 else None, int(g[i, 0]), int(g[i, 1]) if i > 20 else 7) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id long, gex array<double>, ag long, bg long")
    packed = spark.createDataFrame([(i, draw.integers(-2, 4, 5).astype(float).tolist()) for i in range(n) if i != 9], "id long, x array<double>")
    return nodes, packed


def test_sums_and_weight_are_those_of_edges(spark):
    nodes, packed = made(spark)
    for k in (15, 140):
        edges, graph = neighbours.exclusion_knn(nodes, "gex", k).cache(), dense.Nearest(nodes, "gex", k)
        row = lambda r: (r.id, r.part, r.n, tuple(r.x))
        for of in (dense.sums_on, dense.closed_sums):
            want = {row(r) for r in of(edges, packed, ["x"]).collect()}
            assert {row(r) for r in of(graph, packed, ["x"]).collect()} == want and len(want) > 100
        assert dense.weight_of(graph).first().v == dense.weight_of(edges).first().v
        assert dense.weight_of(dense.Nearest(nodes, "gex", k)).first().v == dense.weight_of(edges).first().v
        assert graph._edges is None  # nothing is stored per edge
        small = dense.Nearest(nodes, "gex", k, most_bytes=100)
        assert {row(r) for r in dense.sums_on(small, packed, ["x"]).collect()} == {row(r) for r in dense.sums_on(edges, packed, ["x"]).collect()}


def test_features_on_a_graph_without_edges(spark):
    nodes, packed = made(spark)
    names = [f"f{k}" for k in range(5)]
    edges, graph = neighbours.exclusion_knn(nodes, "gex", 15).cache(), dense.Nearest(nodes, "gex", 15)
    key = lambda r: (r.id, r.pos, r.n_fg, round(r.t, 6), round(r.u, 6), round(r.p_mwu, 6))
    a, b = ({key(r) for r in graph_tests.neighbourhood_tests(g, packed, 5).collect()} for g in (edges, graph))
    assert a == b and a
    a, b = ({(r.feature, round(r.z, 8)) for r in graph_tests.hotspot_packed(g, packed, names).collect()} for g in (edges, graph))
    assert a == b and len(a) == 5


def test_neighbours_are_searched_once_for_tests_of_features(spark):
    nodes, packed = made(spark, 40)
    tests = graph_tests.neighbourhood_tests(neighbours.exclusion_knn(nodes, "gex", 5), packed, 5)
    assert "CartesianProduct" not in tests._jdf.queryExecution().executedPlan().toString() and tests.count() > 0
