"""Every query with SQL against DuckDB on the smallest tables; golden values; edge cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from bispace.functions.stats import benjamini_hochberg, hypergeometric_tail, poisson_tail
from bispace.operators import cells, neighbours, receptors, sequences
from bispace.operators.components import connected_components
from bispace.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def canon(rows):
    """Rows as they are, at the queries' own precision; only the kinds of numbers and lists are made one."""
    one = lambda x: float(x) if x.__class__.__name__ in ("Decimal", "int") else tuple(x) if isinstance(x, list) else x
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in got.fetchall()]
    assert canon([tuple(r[c] for c in columns) for r in df.collect()]) == canon(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_golden_tails(spark):
    lit = F.lit
    assert one(spark, hypergeometric_tail(lit(3), lit(98), lit(10), lit(10))) == pytest.approx(0.06325901647807443, rel=1e-9)
    assert one(spark, hypergeometric_tail(lit(5), lit(990), lit(100), lit(100))) == pytest.approx(0.9825874747374, rel=1e-9)
    assert one(spark, poisson_tail(lit(3), lit(0.5))) == pytest.approx(0.014387677966970713, rel=1e-9)
    assert one(spark, hypergeometric_tail(lit(11), lit(98), lit(10), lit(10))) == 0


def test_golden_fdr(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.04, 0.03, 0.005, 0.5)], "p double")
    got = {r.p: r.fdr for r in benjamini_hochberg(df, "p").collect()}
    assert [got[p] for p in (0.01, 0.04, 0.03, 0.005, 0.5)] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5])


def test_golden_distances(spark):
    cases = [("CAVEALTGGGNKLTF", "CAVPGITGGGNKLTF", 30), ("CASSAYTSGPKEQYF", "CASSLEQGPLQYF", 96), ("CAVEALTGGGNKLTF", "CAVRDLGLTGGGNKLTF", 48), ("CAVRGTGGGNKLTF", "CAVRVGGGNKLTF", 36), ("CASSF", "CASSLGF", 24)]
    df = spark.createDataFrame(cases, "a string, b string, d int")
    for r in df.select("d", sequences.cdr3_distance(F.col("a"), F.col("b")).alias("x"), sequences.cdr3_distance(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.d == r.x == r.y


def test_golden_u_and_density(spark):
    rows = spark.createDataFrame([("k", True, float(x)) for x in (5, 6, 6, 7)] + [("k", False, float(x)) for x in (1, 2, 3, 6, 2)], "k string, f boolean, v double")
    assert neighbours.mann_whitney_u(rows, ["k"], "f", "v").first().u == 18
    edges = spark.createDataFrame([(0, k, float(k), k) for k in (1, 2, 3, 4)], "src long, dst long, dist double, rank int")
    assert neighbours.neighbour_density(edges).first().nndist == pytest.approx(2.0)


def test_components_of_chains_stars_and_nothing(spark):
    pairs = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_knn_by_brute_force_across_blocks(spark):
    points = [(k, k // 2, k % 7, [math.sin(k), math.cos(3 * k)]) for k in range(90)]
    df = spark.createDataFrame(points, "id long, ag long, bg long, v array<double>")
    got = {}
    for r in neighbours.exclusion_knn(df, "v", 5, block=20).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i, a, b, v in points:
        near = sorted((round(math.dist(v, w), 9), j) for j, c, d, w in points if c != a and d != b)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]


def test_receptor_roles_and_samples(spark):
    with pytest.raises(ValueError):
        receptors.chain_role("xx", F.lit("TRA"))
    assert one(spark, receptors.chain_role("gd", F.lit("TRD"))) == "B"
    s = spark.createDataFrame([(1, 2)], "clone long, barcode long")
    assert receptors.merge_samples([s]).first().clone == 1
    assert {r.clone for r in receptors.merge_samples([s, s.withColumn("more", F.lit(1))]).collect()} == {"1-0", "1-1"}


def test_medoid_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 9, [0.0]), (1, 3, [2.0]), (2, 5, [1.0])], "clone long, cell long, v array<double>")
    assert {(r.clone, r.cell, r["size"]) for r in cells.clone_medoid(df).collect()} == {(1, 3, 2), (2, 5, 1)}
