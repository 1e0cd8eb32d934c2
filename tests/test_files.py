"""Readers and writers of text files, round trips and refusals."""

import os

import pytest
from pyspark.sql import functions as F

from bispace.sources import text


def put(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)
    return path


def test_matrix_folder(spark, tmp_path):
    put(tmp_path, "m/matrix.mtx", "%%MatrixMarket matrix coordinate integer general\n%x\n3 2 3\n1 1 5\n3 2 3\n2 1 1\n")
    put(tmp_path, "m/features.tsv", "i1\tG1\tGene Expression\ni2\tG1\tGene Expression\ni3\tP\tAntibody Capture\n")
    put(tmp_path, "m/barcodes.tsv", "AA\nBB\n")
    got = {(r.cell, r.feature, r.feature_type): r.value for r in text.read_expression(spark, f"{tmp_path}/m", "10x_mtx").collect()}
    assert got == {("AA", "G1", "Gene Expression"): 5, ("AA", "G1-1", "Gene Expression"): 1, ("BB", "P", "Antibody Capture"): 3}
    with pytest.raises(ValueError):
        text.read_expression(spark, "x", "loom")


def test_gene_tables(spark, tmp_path):
    head = "id\torganism\tchain\tregion\tnucseq\taligned_protseq\tcdrs\tframe\n"
    good = put(tmp_path, "g.tsv", head + "TRAV1*01\thuman\tA\tV\ttgtgcc\tC.A\tAA;BB;CA\t1\nTRAJ1*01\thuman\tA\tJ\tatgtgcc\tCA\tF\t2\n")
    rows = {r.gene: r for r in text.read_genes(spark, good, "human").collect()}
    assert rows["TRAV1*01"].loops == "AA BB" and rows["TRAJ1*01"].loops is None
    with pytest.raises(ValueError):
        text.read_genes(spark, put(tmp_path, "b.tsv", head + "TRAV1*01\thuman\tA\tV\ttgtgcc\tCC\tAA;CA\t1\n"), "human")
    v = text.read_v_distances(spark, put(tmp_path, "d.txt", "AAdist A 0\nVAdist a 0 3\nVAdist b 3 0\nVBdist c 0\n"))
    assert {(r.chain, r.v1, r.v2): r.d for r in v.collect()} == {("A", "a", "a"): 0, ("A", "a", "b"): 3, ("A", "b", "a"): 3, ("A", "b", "b"): 0, ("B", "c", "c"): 0}


def test_receptor_files(spark, tmp_path):
    good = put(tmp_path, "r.tsv", "va_gene\tcdr3a\tvb_gene\tcdr3b\nA\tCASSF\tB\tCASSG\n")
    assert [(r.id, r.va, r.cdr3b) for r in text.read_receptors(spark, good).collect()] == [(0, "A", "CASSG")]
    with pytest.raises(ValueError):
        text.read_receptors(spark, put(tmp_path, "r2.tsv", "v\tcdr3\nA\tCAS\n"), paired=False)
    known = spark.createDataFrame([("Z", "Z", 0)], "v1 string, v2 string, d int")
    with pytest.raises(ValueError):
        text.read_receptors(spark, good, known)
    assert text.read_literature(spark, good).columns[:4] == ["va", "cdr3a", "vb", "cdr3b"]


def test_models(spark, tmp_path):
    letters = "".join(f"{a}\t{k}\n" for k, a in enumerate(text.AMINO_ACIDS))
    assert text.read_letter_properties(spark, put(tmp_path, "p.tsv", "aa\tx\n" + letters))["x"]["C"] == 1.0
    m = text.read_logistic_model(spark, put(tmp_path, "l.txt", "min_lenbin 9\nmax_lenbin 10\nwindow_size 1\nNV 1\nNJ 1\nTRAV1 0.5\nUNK 0.1\nTRAJ1 0.2\nBIAS -1\n"))
    assert m["v_genes"] == ["TRAV1"] and m["weights"] == [0.5, 0.1, 0.2, -1.0] and m["window"] == 1
    assert [r["feature"] for r in text.read_linear_model(spark, put(tmp_path, "i.tsv", "feature\tmean\tvar\tcoef\tintercept\nlen_A\t1\t1\t0\t2\nlen_B\t1\t1\t3\t2\n"))] == ["len_B"]
    assert text.read_locus_order(spark, put(tmp_path, "o.txt", "IMGT 1\nTRAV2 5\nTRAV1 2 x\n")) == ["TRAV1", "TRAV2"]


def test_batches_and_writers(spark, tmp_path):
    head = "barcode,chain,v_gene,j_gene,cdr3,cdr3_nt,umis,productive,raw_clonotype_id\n"
    a = put(tmp_path, "a.csv", head + "AA-1,TRA,v,j,CASSF,acg,3,True,c1\n")
    b = put(tmp_path, "b.csv", head + "AA-1,TRB,v,j,CASSF,acg,3,TRUE,c1\nAB-1,TRB,v,j,CASSF,acg,3,True,None\n")
    rows = text.read_batches(spark, put(tmp_path, "meta.csv", f"file,batch_id\n{a},1\n{b},2\n")).collect()
    assert {(r.barcode, r.clone, r.productive) for r in rows} == {("AA-1", "c1_1", True), ("AA-2", "c1_2", True)}
    r = spark.createDataFrame([(5, "va", "ja", "ca", "na", "vb", "jb", "cb", "nb")], "id long, va string, ja string, cdr3a string, nta string, vb string, jb string, cdr3b string, ntb string")
    text.write_generic_clones(r, f"{tmp_path}/clones")
    assert text.read_clones(spark, f"{tmp_path}/clones").first().clone_id == "clone_1"
    e = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.7, 2)], "src long, dst long, dist double, rank int")
    both = e.withColumns({"space": F.lit("gex"), "nbr_frac": F.lit(0.1)}).unionByName(e.withColumns({"space": F.lit("tcr"), "nbr_frac": F.lit(0.1)}))
    text.write_edges(both, f"{tmp_path}/edges")
    assert text.read_edges(spark, f"{tmp_path}/edges", "tcr", 0.1).count() == 2
    with pytest.raises(ValueError):
        text.read_edges(spark, f"{tmp_path}/edges", "tcr", 0.2)
    text.write_neighbour_lines(e, f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").first()[0] == "1 2 3"
    text.write_result(e, f"{tmp_path}/out", "edges", "what it is")
    text.write_summary([("Edges", "a < b", e)], f"{tmp_path}/page", "T")
    page = spark.read.text(f"{tmp_path}/page", wholetext=True).first()[0]
    assert "a &lt; b" in page and "<td>0.5</td>" in page and spark.read.text(f"{tmp_path}/out_edges_README.txt").first()[0] == "what it is"
    text.write_checkpoint({"edges": e}, f"{tmp_path}/run")
    assert text.read_checkpoint(spark, f"{tmp_path}/run", ["edges"])["edges"].count() == 2
    p = spark.createDataFrame([(1, 0.5, 1.0, 2, 3, "va", "ja", "ca", "vb", "jb", "cb")], "id long, x double, y double, cg long, ct long, va string, ja string, cdr3a string, vb string, jb string, cdr3b string")
    text.write_projection(p, f"{tmp_path}/proj")
    assert spark.read.text(f"{tmp_path}/proj").first()[0].startswith("clone: 1 clusters_gex: 2")
