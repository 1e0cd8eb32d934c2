"""Text readers and writers by round trip, and p-values against golden and closed-form values."""

import math

import pytest
from pyspark.sql import functions as F

from bispace.functions.stats import mann_whitney_p, normal_tail, student_two_sided
from bispace.operators.neighbours import mann_whitney_u
from bispace.sources import text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("z", [-2.0, 0.0, 0.5, 1.96, 2.999, 3.0, 8.0, 20.0])
def test_normal_tail(spark, z):
    assert value(spark, normal_tail(F.lit(z))) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-9)


@pytest.mark.parametrize("t", [0.0, 0.1, -1.0, 2.5, 40.0])
def test_student_of_one_and_two(spark, t):
    assert value(spark, student_two_sided(F.lit(t), F.lit(1.0))) == pytest.approx(1 - 2 * math.atan(abs(t)) / math.pi, rel=1e-7)
    assert value(spark, student_two_sided(F.lit(t), F.lit(2.0))) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), rel=1e-7)


def p_of(spark, x, y, two_sided):
    df = spark.createDataFrame([(1, True, float(v)) for v in x] + [(1, False, float(v)) for v in y], "k int, g boolean, v double")
    r = mann_whitney_u(df, ["k"], "g", "v").select("u", mann_whitney_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties"), two_sided).alias("p")).first()
    return r.u, r.p


def test_mann_whitney_golden(spark):
    assert p_of(spark, [1, 2, 3], [4, 5, 6], True) == (0, pytest.approx(0.0808555983700523, rel=1e-9))
    assert p_of(spark, [5, 6, 6, 7], [1, 2, 3, 6, 2], False) == (18, pytest.approx(0.030284430101328728, rel=1e-9))
    assert p_of(spark, [1, 1], [1, 1], True)[1] == 1


def test_round_trips(spark, tmp_path):
    clone = {c: f"x{c}" for c in text.CLONE_COLUMNS} | {"clone_size": 3}
    df = spark.createDataFrame([clone]).withColumnRenamed("va_gene", "va")
    text.write_clones(df, f"{tmp_path}/clones")
    assert text.read_clones(spark, f"{tmp_path}/clones").first().asDict() == clone
    with pytest.raises(ValueError):
        text.read_clones(spark, f"{tmp_path}/clones", ";")
    rows = [("c1", ["b", "a"]), ("c2", [])]
    text.write_barcode_map(spark.createDataFrame(rows, "clone_id string, barcodes array<string>"), f"{tmp_path}/map")
    assert sorted(map(tuple, text.read_barcode_map(spark, f"{tmp_path}/map").collect())) == [("c1", ["a", "b"]), ("c2", [])]
    text.write_kernel_components(spark.createDataFrame([("c1", [1.5, -2.0])], "clone_id string, kpc array<double>"), f"{tmp_path}/kpc")
    assert [tuple(r) for r in text.read_kernel_components(spark, f"{tmp_path}/kpc").collect()] == [("c1", [1.5, -2.0])]


def test_contigs_and_distances(spark, tmp_path):
    head = "barcode,chain,v_gene,j_gene,cdr3,cdr3_nt,umis,productive,raw_clonotype_id"
    (tmp_path / "c.csv").write_text(f"{head}\nb1,TRA,v,j,CA,tg,4,True,clonotype1\nb2,TRB,v,j,CA,tg,1,None,clonotype1\nb3,TRB,v,j,CA,tg,1,True,none\n")
    got = {r.barcode: (r.umis, r.productive) for r in text.read_contigs(spark, f"{tmp_path}/c.csv").collect()}
    assert got == {"b1": (4, True), "b2": (1, False)}
    (tmp_path / "d.txt").write_text("AAdist C " + " ".join(map(str, range(20))) + "\nnum_VA_genes 0\n")
    got = {(r.a, r.b): r.d for r in text.read_letter_distances(spark, f"{tmp_path}/d.txt").collect()}
    assert len(got) == 20 and got["C", "A"] == 0 and got["C", "Y"] == 19
