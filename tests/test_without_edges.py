"""Counts, lengths, averages and agreement on graphs without edges are those of the edge tables, which are never made."""

import numpy as np
from pyspark.sql import functions as F

from bispace.operators import dense, graph_tests, neighbours
from bispace.plans import graph_queries, registry
from tests.test_dense import made


def rounded(rows):
    return {tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows.collect()}


def test_lengths_and_indegrees(spark):
    nodes, packed = made(spark)
    for k in (15, 140):
        edges, graph = neighbours.exclusion_knn(nodes, "gex", k).cache(), dense.Nearest(nodes, "gex", k)
        want = None
        for m in (4, k):
            e = edges.where(F.col("rank") <= m)
            part = e.groupBy(F.col("src").alias("id")).agg(F.count("*"), F.max("dist")).join(neighbours.neighbour_density(e), "id")
            part = part.select("id", F.lit(m).alias("k"), *part.columns[1:])
            want = part if want is None else want.unionByName(part)
        got = graph.lengths([4, k])
        assert rounded(got) == rounded(want) and got.columns == ["id", "k", "n", "reach", "nndist"]
        assert rounded(dense.Nearest(nodes, "gex", k, most_bytes=100).lengths([4, k])) == rounded(want)
        assert rounded(graph.indegree()) == rounded(neighbours.indegree(edges, nodes)) and graph._edges is None
        values = packed.select("id", F.col("x")[1].alias("value"))
        assert rounded(dense.average(graph, values)) == rounded(dense.average(edges, values))
        assert rounded(graph_tests.extreme_subset(values, graph, k, 0.1)) == rounded(graph_tests.extreme_subset(values, edges, k, 0.1))
        long_ = packed.select("id", F.posexplode("x").alias("feature", "value"))
        assert rounded(dense.hotspot(graph, packed)) == rounded(neighbours.hotspot(edges, long_)) and graph._edges is None


def test_agreement_by_masks(spark):
    draw = np.random.default_rng(5)
    n = 120
    x, y, g = draw.integers(0, 4, (n, 2)).astype(float), draw.integers(0, 4, (n, 2)).astype(float), draw.integers(0, 50, (n, 2))
    rows = [(i, x[i].tolist() if i != 3 else None, x[i].tolist() if i % 2 else y[i].tolist(), int(g[i, 0]), int(g[i, 1]), None if i == 7 else i % 3, i % 4) for i in range(n)]
    nodes = spark.createDataFrame(rows, "id long, gex array<double>, tcr array<double>, ag long, bg long, cg long, ct long")
    for spaces in (("gex", "tcr"), ("gex", "gex")):
        want = rounded(neighbours.agreement(nodes, spaces, [6, 24, 130], ("cg", "ct"), block=16))
        assert rounded(dense.agreement(nodes, spaces, [6, 24, 130], ("cg", "ct"))) == want and len(want) == 3 * n
        assert rounded(dense.agreement(nodes, spaces, [6, 24, 130], ("cg", "ct"), most_bytes=100)) == want
        some = neighbours.agreement(nodes, spaces, [6], ("cg", "ct"), block=16).select("id", "k", "a", "b", "right", "right_groups")
        assert rounded(dense.agreement(nodes, spaces, [6], ("cg", "ct"), wanted=("right",))) == rounded(some)


def test_tails_are_dealt_to_tasks(spark):
    nodes = spark.createDataFrame([(i, i, i, 1) for i in range(40)], "id long, ag long, bg long, c int")
    edges = spark.createDataFrame([(i, (i + d) % 40) for i in range(40) for d in (1, 2)], "src long, dst long")
    done = neighbours.graph_vs_cluster(edges, nodes, "c")
    assert done.count() == 40 and done.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_queries_make_no_edges(spark, monkeypatch):
    made_ = []
    monkeypatch.setattr(neighbours, "exclusion_knn", lambda *a, **k: made_.append(a) or 1 / 0)
    for name in ("knn_multi_frac", "nn_density", "graph_overlap", "graph_vs_graph_score", "graph_vs_cluster", "graph_indegree_stats", "hotspot_z"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count()
    for name in ("averaged_regression", "extreme_subset", "density_positions"):
        getattr(graph_queries, name)(spark, "/root/testdata/sf0.001").count()
    assert not made_
