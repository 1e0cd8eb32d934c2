"""Queries that write a file form into the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bispace.operators import neighbours
from bispace.plans.base import query
from bispace.plans.receptor_queries import R
from bispace.plans.registry import _EDGE, NODES, _knn
from bispace.session import work_dir, work_table
from bispace.sources import adapters, text


def _place(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT CAST(l_orderkey AS VARCHAR) AS cell, CAST(l_suppkey AS VARCHAR) AS feature, 'Gene Expression' AS feature_type, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY ALL")
def matrix_folder(spark, sf_dir):
    path = _place(spark, "matrix")
    text.write_matrix(adapters.cell_gene(spark, sf_dir).groupBy("cell", "feature").agg(F.sum("value").cast("double").alias("value")), path)
    return text.read_expression(spark, path, "10x_mtx")


_FRACTION = "(SELECT greatest(1, CAST(floor(0.01 * count(*)) AS BIGINT)) FROM nodes)"


@query(f"WITH {NODES}, {_knn('tcr', _FRACTION)} {_EDGE}tcr")
def stored_graphs(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    count, path = n.count(), _place(spark, "graphs")
    graphs = [neighbours.exclusion_knn(n, s, max(1, int(f * count))).withColumns({"space": F.lit(s), "nbr_frac": F.lit(f)}) for s in ("gex", "tcr") for f in (0.01, 0.02)]
    whole = graphs[0]
    for g in graphs[1:]:
        whole = whole.unionByName(g)
    text.write_edges(whole, path)
    return text.read_edges(spark, path, "tcr", 0.01).select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {NODES}, {_knn('gex', '5')} SELECT CAST(src AS VARCHAR) || ' ' || string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY rank) AS value FROM knn_gex GROUP BY src")
def neighbour_lines(spark, sf_dir):
    path = _place(spark, "lines")
    text.write_neighbour_lines(neighbours.exclusion_knn(adapters.nodes(spark, sf_dir), "gex", 5), path)
    return spark.read.text(path)


@query(f"WITH {R} SELECT 'clone_' || row_number() OVER (ORDER BY id) AS clone_id, 'me' AS subject, 'UNK_E' AS epitope, va AS va_gene, jb AS jb_gene, cdr3a, 'acg' AS cdr3a_nucseq, cdr3b FROM r")
def generic_clones(spark, sf_dir):
    path = _place(spark, "clones")
    text.write_generic_clones(adapters.receptors(spark, sf_dir).withColumns({"nta": F.lit("acg"), "ntb": F.lit("gca")}), path, subject="me")
    return spark.read.option("header", True).option("sep", "\t").csv(path).select("clone_id", "subject", "epitope", "va_gene", "jb_gene", "cdr3a", "cdr3a_nucseq", "cdr3b")


@query(f"WITH {NODES} SELECT CAST(id AS VARCHAR) AS clone_id, list_transform(gex, lambda v: floor(v * 1000) / 1000) AS kpc FROM nodes")
def kernel_lines(spark, sf_dir):
    path = _place(spark, "kernel")
    thousandths = F.transform("gex", lambda v: F.floor(v * 1000) / 1000)  # the file holds six decimals
    text.write_kernel_components(adapters.nodes(spark, sf_dir).select(F.col("id").alias("clone_id"), thousandths.alias("kpc")), path)
    return text.read_kernel_components(spark, path)


@query(f"WITH {R} SELECT 'clone: ' || id || ' clusters_gex: ' || cg || ' clusters_tcr: ' || ct || ' xy: ' || id || '.000 ' || cg || '.000 ' || va || ' ' || ja || ' ' || cdr3a || ' ' || vb || ' ' || jb || ' ' || cdr3b AS value FROM r")
def projection_lines(spark, sf_dir):
    path = _place(spark, "projection")
    text.write_projection(adapters.receptors(spark, sf_dir).withColumns({"x": F.col("id").cast("double"), "y": F.col("cg").cast("double")}), path)
    return spark.read.text(path)


@query(f"WITH {R} SELECT CAST(bg AS VARCHAR) AS clone_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS barcodes FROM r GROUP BY bg")
def barcode_map(spark, sf_dir):
    path = _place(spark, "map")
    r = adapters.receptors(spark, sf_dir)
    text.write_barcode_map(r.groupBy(F.col("bg").alias("clone_id")).agg(F.collect_list(F.col("id").cast("string")).alias("barcodes")), path)
    return text.read_barcode_map(spark, path).select("clone_id", F.concat_ws(",", "barcodes").alias("barcodes"))


@query(f"WITH {R} SELECT CAST(id AS VARCHAR) AS id, cdr3a, CAST(clone_size AS VARCHAR) AS clone_size, 1 AS n_notes FROM r")
def result_table(spark, sf_dir):
    path = _place(spark, "result")
    text.write_result(adapters.receptors(spark, sf_dir).select("id", "cdr3a", "clone_size"), path, "rows", "receptors and their sizes")
    notes = spark.read.text(f"{path}_rows_README.txt").count()
    return spark.read.option("header", True).option("sep", "\t").csv(f"{path}_rows.tsv").withColumn("n_notes", F.lit(notes).cast("int"))


@query(f"WITH {NODES} SELECT id, ag, bg, cg FROM nodes")
def restarted_run(spark, sf_dir):
    path = _place(spark, "run")
    n = adapters.nodes(spark, sf_dir)
    text.write_checkpoint({"nodes": n.select("id", "ag", "bg"), "clusters": n.select("id", "cg")}, path)
    back = text.read_checkpoint(spark, path, ["nodes", "clusters"])
    return work_table(back["nodes"].join(back["clusters"], "id"), "restarted")
