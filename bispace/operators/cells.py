"""Aggregations over cells, features and clones: filters, normalisation, medoids, contingencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.operators.windows import dealt
from bispace.session import work_table


def qc_filter(counts: DataFrame, mito: Column, min_features: int, max_features: int, max_mito: float, min_cells: int) -> DataFrame:
    """Cells (cell, n_features, total, mito_share) that pass; order: few features, rare features, rest.
    A cell whose counts sum to zero has no mitochondrial share (0)."""
    counts, parts = dealt(counts.where("cell is not null").withColumn("_m", mito), "cell", 500_000)
    one = counts.groupBy("cell", "feature").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("_m"), F.col("value")).otherwise(0.0)).alias("mito"))
    enough = F.count("feature").over(Window.partitionBy("cell")) >= min_features
    one = work_table(one.withColumn("_k", enough).where("_k").drop("_k"), "features")
    common = one.groupBy("feature").agg(F.count("*").alias("k")).where(F.col("k") >= min_cells).select("feature")
    kept = one.join(common, "feature", "left_semi").repartition(parts, "cell")
    share = F.coalesce(F.try_divide(F.sum("mito"), F.sum("value")), F.lit(0.0))
    cells = kept.groupBy("cell").agg(F.count("feature").alias("n_features"), F.sum("value").alias("total"), share.alias("mito_share"))
    return cells.where((F.col("n_features") < max_features) & (F.col("mito_share") < max_mito))


def normalize_log1p(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell, feature, x): values scaled to ``target`` per cell, then log1p; zeros in a cell without counts."""
    one = counts.groupBy("cell", "feature").agg(F.sum("value").alias("value"))
    total = one.groupBy("cell").agg(F.sum("value").alias("total"))
    return one.join(total, "cell").select("cell", "feature", F.coalesce(F.log1p(F.try_divide(F.col("value") * target, F.col("total"))), F.lit(0.0)).alias("x"))


def dispersion(normalised: DataFrame, n_cells: int) -> DataFrame:
    """(feature, mean, dispersion): moments over all cells, absent values being zero; a feature of zeros
    or without variance has no dispersion (null)."""
    s = normalised.withColumn("e", F.expm1("x")).groupBy("feature").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss"))
    mean = F.col("s") / n_cells
    var = F.greatest(F.col("ss") - n_cells * mean * mean, F.lit(0.0)) / max(n_cells - 1, 1)
    ratio = F.try_divide(var, mean)
    return s.select("feature", F.log1p(mean).alias("mean"), F.when(ratio > 0, F.log(ratio)).alias("dispersion"))


def clone_medoid(cells: DataFrame) -> DataFrame:
    """(clone, cell, size, variation): the cell (clone, cell, v) with the smallest summed distance to
    its clone's cells, first by id on ties, and the root mean squared distance to it."""
    b = cells.select("clone", F.col("cell").alias("other"), F.col("v").alias("w"))
    gap = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    d = cells.join(b, "clone").select("clone", "cell", gap.alias("d2")).groupBy("clone", "cell").agg(F.sum(F.sqrt("d2")).alias("total"), F.avg("d2").alias("d2"), F.count("*").alias("size"))
    first = F.row_number().over(Window.partitionBy("clone").orderBy(F.round("total", 9), "cell"))
    return d.withColumn("r", first).where("r = 1").select("clone", "cell", "size", F.sqrt("d2").alias("variation"))


def batch_frequency(rows: DataFrame) -> DataFrame:
    """(clone, batch, n, frequency) of rows (clone, batch)."""
    n = rows.groupBy("clone", "batch").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("clone").agg(F.sum("n").alias("all")), "clone").select("clone", "batch", "n", (F.col("n") / F.col("all")).alias("frequency"))


def cluster_contingency(rows: DataFrame) -> DataFrame:
    """(a, b, n, margin_a, margin_b): the smaller number of distinct groups per pair of clusters."""
    n = rows.groupBy("a", "b").agg(F.least(F.countDistinct("ag"), F.countDistinct("bg")).alias("n"))
    return n.join(n.groupBy("a").agg(F.sum("n").alias("margin_a")), "a").join(n.groupBy("b").agg(F.sum("n").alias("margin_b")), "b").select("a", "b", "n", "margin_a", "margin_b")


def dense_group_ids(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """0-based position of each row's tuple among the sorted distinct tuples; only these are ordered,
    in ranges. Rows with a null in the tuple are left out."""
    from bispace.operators.windows import running_sum

    ranks = running_sum(rows.select(*columns).na.drop().distinct(), [], [F.col(c) for c in columns], F.lit(1), out)
    return rows.join(ranks.withColumn(out, F.col(out) - 1), columns)
