"""Aggregations over cells, features, clusters and batches beyond those of ``cells``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def antibody_clr(counts: DataFrame, n_features: int) -> DataFrame:
    """(cell, feature, x): log1p of antibody counts less the cell's mean over all antibodies, absent ones being 0."""
    one = counts.groupBy("cell", "feature").agg(F.log1p(F.sum("value")).alias("x"))
    mean = one.groupBy("cell").agg((F.sum("x") / max(n_features, 1)).alias("mean"))
    return one.join(mean, "cell").select("cell", "feature", (F.col("x") - F.col("mean")).alias("x"))


def check_raw_counts(counts: DataFrame, least: float = 100.0) -> DataFrame:
    """``counts``, or an error if the median total of cells is so low that they look normalised already."""
    median = counts.groupBy("cell").agg(F.sum("value").alias("t")).agg(F.percentile_approx("t", 0.5)).first()[0]
    if median is not None and median < least:
        raise ValueError(f"median of counts is {median}: normalised already?")
    return counts


def variable_features(moments: DataFrame, bins: int = 20, min_mean: float = 0.0125, max_mean: float = 3.0, least: float = 0.5) -> DataFrame:
    """(feature, mean, dispersion, normalised, variable) of (feature, mean, dispersion): dispersions
    standardised within ``bins`` bins of equal width over the means. A bin of one feature gives it 1;
    features without a dispersion are in no bin and not variable."""
    span = moments.where("dispersion is not null").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.greatest(F.ceil(F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), width), F.lit(1.0))), F.lit(1)), F.lit(bins))
    placed = moments.crossJoin(F.broadcast(span)).withColumn("bin", F.when(F.col("dispersion").isNotNull(), at))
    stat = placed.where("bin is not null").groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("s"), F.count("*").alias("n"))
    z = F.when(F.col("n") == 1, 1.0).otherwise(F.try_divide(F.col("dispersion") - F.col("m"), F.col("s")))
    out = placed.join(F.broadcast(stat), "bin", "left").withColumn("normalised", z)
    good = F.coalesce((F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("normalised") > least), F.lit(False))
    return out.select("feature", "mean", "dispersion", "normalised", good.alias("variable"))


def chosen_features(features: DataFrame, drop: Column, forced: list | None = None, extra: list | None = None) -> DataFrame:
    """(feature) that are variable: a forced list stands instead, an extra one is added, and dropped ones go."""
    use = F.col("feature").isin(*forced) if forced is not None else F.col("variable")
    if extra:
        use = use | F.col("feature").isin(*extra)
    return features.where(use & ~drop).select("feature")


def regressed(values: DataFrame, covariates: DataFrame, clip: float = 10.0) -> DataFrame:
    """(id, feature, z): residuals of each feature's values (id, feature, value; dense) after a linear fit
    on two covariates (id, u, v), standardised and clipped at both ends.

    Normal equations by sums in one pass over the values; a covariate without variance takes no part, a
    feature without any left is 0.
    """
    c = covariates.select("id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    m = c.agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.var_pop("u").alias("vu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("cuv"))
    rows = values.join(c, "id")
    fit = rows.groupBy("feature").agg(F.avg("value").alias("my"), F.covar_pop("u", "value").alias("cu"), F.covar_pop("v", "value").alias("cv")).crossJoin(F.broadcast(m))
    det = F.col("vu") * F.col("vv") - F.col("cuv") * F.col("cuv")
    ok = det > 1e-12
    one = lambda c, v: F.coalesce(F.try_divide(F.col(c), F.col(v)), F.lit(0.0))
    bu = F.when(ok, F.try_divide(F.col("cu") * F.col("vv") - F.col("cv") * F.col("cuv"), det)).when(F.col("vu") > 0, one("cu", "vu")).otherwise(0.0)
    bv = F.when(ok, F.try_divide(F.col("cv") * F.col("vu") - F.col("cu") * F.col("cuv"), det)).when((F.col("vu") <= 0) & (F.col("vv") > 0), one("cv", "vv")).otherwise(0.0)
    fit = fit.select("feature", "my", "mu", "mv", bu.alias("bu"), bv.alias("bv"))
    rest = rows.join(fit, "feature").select("id", "feature", (F.col("value") - F.col("my") - F.col("bu") * (F.col("u") - F.col("mu")) - F.col("bv") * (F.col("v") - F.col("mv"))).alias("e"))
    sd = rest.groupBy("feature").agg(F.stddev_samp("e").alias("sd"))
    z = F.when(F.col("sd") > 1e-9, F.try_divide(F.col("e"), F.col("sd"))).otherwise(0.0)
    return rest.join(sd, "feature").select("id", "feature", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("z"))


def clone_batches(cells: DataFrame) -> DataFrame:
    """(clone, key, choice, n): cells (clone, key, choice) of each clone in each choice of each batch key."""
    return cells.groupBy("clone", "key", "choice").agg(F.count("*").alias("n"))


def clone_means(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(clone, feature, mean): mean over a clone's cells (clone, cell) of sparse values (cell, feature, x)."""
    n = cells.groupBy("clone").agg(F.count("*").alias("n"))
    return cells.join(values, "cell").groupBy("clone", "feature").agg(F.sum("x").alias("s")).join(n, "clone").select("clone", "feature", (F.col("s") / F.col("n")).alias("mean"))


def gene_score(values: DataFrame, members: DataFrame, genes: list, normed: bool = False) -> DataFrame:
    """One row (score): mean over the genes there are of their mean over the members (id); ``normed``
    standardises each gene over all rows first, clipped at 10. Null without any gene or member."""
    v = values.where(F.col("feature").isin(*genes))
    if normed:
        s = v.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
        z = F.coalesce(F.try_divide(F.col("value") - F.col("m"), F.col("sd")), F.lit(0.0))
        v = v.join(F.broadcast(s), "feature").withColumn("value", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z)))
    return v.join(members.select("id").distinct(), "id", "left_semi").groupBy("feature").agg(F.avg("value").alias("m")).agg(F.avg("m").alias("score"))


def cluster_gene_scores(values: DataFrame, nodes: DataFrame, cluster: str, sets: dict[str, list]) -> DataFrame:
    """(cluster, set, score): gene_score of each marker set in each cluster."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("set"), F.lit(g).alias("feature")) for k, gs in sets.items() for g in gs]))
    wanted = values.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
    each = values.join(F.broadcast(wanted), "feature").join(nodes.select("id", F.col(cluster).alias("cluster")), "id")
    return each.groupBy("cluster", "set", "feature").agg(F.avg("value").alias("m")).groupBy("cluster", "set").agg(F.avg("m").alias("score"))


def biclusters(nodes: DataFrame, good: Column, least: int = 5) -> DataFrame:
    """(cg, ct, n): pairs of clusters with at least ``least`` good nodes."""
    return nodes.where(good).groupBy("cg", "ct").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def least_bicluster(n: int) -> int:
    return max(5, int(0.5 + 0.001 * n))


def cluster_composition(receptors: DataFrame, cluster: str) -> DataFrame:
    """(cluster, slot, gene, n, fraction) of the V and J genes within each cluster, and over all as cluster -1."""
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.substring_index(s, "*", 1).alias("gene")) for s in ("va", "ja", "vb", "jb")])
    rows = receptors.select(F.explode(F.array(F.col(cluster).cast("long"), F.lit(-1).cast("long"))).alias("cluster"), slots.alias("s")).select("cluster", F.explode("s").alias("s")).select("cluster", "s.*")
    n = rows.groupBy("cluster", "slot", "gene").agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("cluster", "slot")))


def frequent_genes(receptors: DataFrame, least: int = 5) -> DataFrame:
    """(gene, n): genes without allele over the four slots, at least ``least`` of them."""
    g = receptors.select(F.explode(F.array(*[F.substring_index(s, "*", 1) for s in ("va", "ja", "vb", "jb")])).alias("gene"))
    return g.groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def logo_stats(values: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, feature, fraction, mean, scaled): share of a group's nodes that express a gene, its mean, and
    the mean over the greatest of any group (0 if none is above 0)."""
    n = groups.groupBy("group").agg(F.count("*").alias("size"))
    s = values.join(groups, "id").groupBy("group", "feature").agg(F.count(F.when(F.col("value") > 0, 1)).alias("k"), F.sum("value").alias("s"))
    s = s.join(n, "group").select("group", "feature", (F.col("k") / F.col("size")).alias("fraction"), (F.col("s") / F.col("size")).alias("mean"))
    top = s.groupBy("feature").agg(F.max("mean").alias("top"))
    return s.join(top, "feature").select("group", "feature", "fraction", "mean", F.when(F.col("top") > 0, F.col("mean") / F.col("top")).otherwise(0.0).alias("scaled"))


def literature_labels(matches: DataFrame) -> DataFrame:
    """(label, n_clones, weight) of matches (id, d, epitope, gene, mhc): a clone's nearest match counts
    (ties by label); a missing epitope is its gene's name, or UNKNOWN. The weight is the number of clones
    less 0.1 for each side of the label that isn't known."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    epitope, mhc = F.coalesce(blank("epitope"), blank("gene"), F.lit("UNKNOWN")), F.coalesce(blank("mhc"), F.lit("UNKNOWN"))
    m = matches.select("id", "d", epitope.alias("e"), mhc.alias("h")).withColumn("label", F.concat_ws("-", "h", "e"))
    best = m.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "label"))).where("r = 1")
    lack = (F.col("e") == "UNKNOWN").cast("int") + (F.col("h") == "UNKNOWN").cast("int")
    return best.groupBy("label").agg(F.countDistinct("id").alias("n_clones"), F.max(lack).alias("lack")).select("label", "n_clones", (F.col("n_clones") - 0.1 * F.col("lack")).alias("weight"))


def largest_clones(sizes: DataFrame, most: int = 75, least: int = 5) -> DataFrame:
    """The ``most`` largest clones (id, size) of at least ``least`` cells; ties to the larger id."""
    return sizes.where(F.col("size") >= least).orderBy(F.desc("size"), F.desc("id")).limit(most)


def unlogged(values: DataFrame) -> DataFrame:
    """(cell, feature, n): counts behind log-normalised values (cell, feature, x), each cell's least nonzero being 1."""
    e = values.where("x > 0").select("cell", "feature", F.expm1("x").alias("e"))
    least = e.groupBy("cell").agg(F.min("e").alias("one"))
    return e.join(least, "cell").select("cell", "feature", (F.col("e") / F.col("one")).alias("n"))


def ring_points(points: DataFrame, by: str, n: int, radius: float = 0.25) -> DataFrame:
    """(by, k, x, y): n places on a ring around the mean of a group's points, ``radius`` times its root mean
    squared distance from the mean; the first lies above. One place is the mean itself."""
    from math import pi

    mean = points.groupBy(by).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("sd"))
    angle = F.lit(2 * pi / n) * F.col("k")
    size = F.col("sd") * (radius if n > 1 else 0.0)
    return mean.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(by, "k", (F.col("mx") + size * F.sin(angle)).alias("x"), (F.col("my") + size * F.cos(angle)).alias("y"))


def permuted(rows: DataFrame, column: str, seed: int = 1) -> DataFrame:
    """``rows`` (id, ...) with the values of a column dealt anew among them, for null distributions."""
    from bispace.operators.windows import running_sum

    slot = running_sum(rows.select("id", F.col(column).alias("_value")), [], [F.col("id")], F.lit(1), "_slot")
    drawn = running_sum(rows.select("id", F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))).alias("_h")), [], [F.col("_h"), F.col("id")], F.lit(1), "_slot")
    return rows.drop(column).join(drawn.select("id", "_slot").join(slot.select("_slot", F.col("_value").alias(column)), "_slot"), "id").drop("_slot")
