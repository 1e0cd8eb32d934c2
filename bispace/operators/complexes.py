"""Binding of peptide complexes: positive cells, clones and neighbourhoods, and their combined p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions.stats import hypergeometric_tail
from bispace.session import work_table

#: By how much the best complex must exceed the second, in logs and in counts; least positives.
LOG_DELTA, COUNT_DELTA, MIN_POSITIVE = 2.0, 3.0, 3


def positives(values: DataFrame, log_delta: float = LOG_DELTA, count_delta: float = COUNT_DELTA) -> DataFrame:
    """(id, complex) of rows (id, complex, x = log1p of counts) whose best complex stands out from the
    second; a missing second counts 0, equal bests have none."""
    w = Window.partitionBy("id").orderBy(F.desc("x"), "complex")
    top = values.select("id", "complex", "x", F.row_number().over(w).alias("r"), F.lead("x", 1, 0.0).over(w).alias("second")).where("r = 1")
    return top.where((F.col("x") - F.col("second") >= log_delta) & (F.expm1("x") - F.expm1("second") >= count_delta)).select("id", "complex")


def above(values: DataFrame, threshold: float) -> DataFrame:
    """(id, complex) of all values of at least a threshold, whatever the others."""
    return values.where(F.col("x") >= threshold).select("id", "complex")


def clone_enrichment(cells: DataFrame, values: DataFrame, log_delta: float = LOG_DELTA) -> DataFrame:
    """(clone, complex, n_positive, clone_size, pvalue, log_delta) of clones (clone, id): the positive cells
    of a clone against all cells' by the hypergeometric tail, and its mean over the best other complex's."""
    pos = positives(values, log_delta)
    n = cells.count()
    all_ = pos.groupBy("complex").agg(F.count("*").alias("all"))
    size = cells.groupBy("clone").agg(F.count("*").alias("clone_size"))
    own = pos.join(cells, "id").groupBy("clone", "complex").agg(F.count("*").alias("n_positive")).join(all_, "complex").join(size, "clone")
    means = values.join(cells, "id").groupBy("clone", "complex").agg(F.sum("x").alias("s")).join(size, "clone").select("clone", "complex", (F.col("s") / F.col("clone_size")).alias("mean"))
    w = Window.partitionBy("clone").orderBy(F.desc("mean"), "complex")
    two = means.withColumns({"r": F.row_number().over(w), "next": F.lead("mean", 1, 0.0).over(w)}).withColumn("best", F.max("mean").over(Window.partitionBy("clone")))
    delta = two.select("clone", "complex", F.when(F.col("r") == 1, F.col("mean") - F.col("next")).otherwise(F.col("mean") - F.col("best")).alias("log_delta"))
    p = hypergeometric_tail(F.col("n_positive"), F.lit(n), F.col("all"), F.col("clone_size"))
    return own.join(delta, ["clone", "complex"]).select("clone", "complex", "n_positive", "clone_size", p.alias("pvalue"), "log_delta")


def product_p(p: Column, q: Column) -> Column:
    """P(the product of two uniform numbers is at most p q)."""
    x = p * q
    return F.when(x > 0, x * (1 - F.log(x))).otherwise(0.0)


def greatest_p(p: Column, m: Column) -> Column:
    """P(the greatest of m independent variables reaches what one reaches with probability p)."""
    return F.when(p >= 1, F.when(m > 0, 1.0).otherwise(0.0)).otherwise(-F.expm1(m * F.log1p(-p)))


def peeled_p(positive: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(complex, pvalue): how unlikely the neighbours are that positives (complex, id) share with positives.

    In a round every complex loses its strongest node (most positive neighbours, ties to the smallest
    id) with the node's neighbours and its groups. The node's tail probability among nodes outside its
    groups, as the greatest of those that were left, is multiplied into the complex's, and the least
    product so far is its p-value. A complex ends when the strongest has no positive neighbour, fewer
    than chance would give, or a tail that isn't below one over those left. All complexes go through a
    round together, as joins; rounds are as many as the longest peel.
    """
    g = nodes.select("id", "ag", "bg")
    population = g.count()
    size = {n: g.groupBy(*c).agg(F.count("*").alias(n)) for n, c in (("sa", ["ag"]), ("sb", ["bg"]), ("sab", ["ag", "bg"]))}
    of = g.join(size["sa"], "ag").join(size["sb"], "bg").join(size["sab"], ["ag", "bg"]).select("id", "ag", "bg", (F.lit(population) - F.col("sa") - F.col("sb") + F.col("sab")).alias("possible"))
    left = work_table(positive.select("complex", "id").distinct().join(of, "id"), "positives")
    done = left.select("complex").distinct().select("complex", F.lit(None).cast("double").alias("combined"), F.lit(1.0).alias("pvalue"))
    links = edges.select("src", "dst").join(left.select("complex", F.col("id").alias("src")), "src")
    links = work_table(links, "links")
    degree = work_table(links.groupBy("complex", "src").agg(F.count("*").alias("k")).groupBy("complex").agg(F.max("k").alias("k")), "degrees")
    while True:
        near = links.join(left.select("complex", F.col("id").alias("dst")), ["complex", "dst"]).groupBy("complex", F.col("src").alias("id")).agg(F.count("*").alias("n"))
        met = near.join(left, ["complex", "id"])
        top = met.groupBy("complex").agg(F.min(F.struct((-F.col("n")).alias("less"), "id", "ag", "bg", "possible")).alias("t"))
        top = top.select("complex", (-F.col("t.less")).alias("n"), F.col("t.id").alias("top"), F.col("t.ag").alias("ta"), F.col("t.bg").alias("tb"), F.col("t.possible").alias("possible"))
        count = left.join(top, "complex").groupBy("complex").agg(F.count("*").alias("m"), F.count(F.when((F.col("ag") != F.col("ta")) & (F.col("bg") != F.col("tb")), 1)).alias("good"))
        step = top.join(count, "complex").join(degree, "complex").where("possible > 0 and n * possible >= good * k")
        step = step.withColumn("p", hypergeometric_tail(F.col("n"), F.col("possible"), F.col("good"), F.col("k"))).where("p * m <= 1")
        step = work_table(step, "peeled")
        if step.isEmpty():
            return done.select("complex", "pvalue")
        tail = step.select("complex", greatest_p(F.col("p"), F.col("m")).alias("tail"), F.lit(True).alias("on"))
        joined = done.join(tail, "complex", "left").withColumn("combined", F.when(F.col("on"), F.when(F.col("combined").isNull(), F.col("tail")).otherwise(product_p(F.col("combined"), F.col("tail")))).otherwise(F.col("combined")))
        done = work_table(joined.select("complex", "combined", F.when(F.col("on"), F.least("pvalue", "combined")).otherwise(F.col("pvalue")).alias("pvalue")), "combined")
        gone = links.join(step.select("complex", F.col("top").alias("src")), ["complex", "src"]).select("complex", F.col("dst").alias("id")).distinct()
        stay = left.join(step.select("complex", "ta", "tb"), "complex").where("ag <> ta and bg <> tb").join(gone, ["complex", "id"], "left_anti")
        left = work_table(stay.select("complex", "id", "ag", "bg", "possible"), "positives")


def complexes_on_graph(positive: DataFrame, edges: DataFrame, nodes: DataFrame, least: int = MIN_POSITIVE) -> DataFrame:
    """(complex, num_positive_clones, total_nbrs, expected_total_nbrs, max_nbrs, log2_enrich, pvalue) of
    complexes with ``least`` positive nodes (id, complex): neighbours of positives that are positive for
    the same, against chance among the nodes outside their groups, with the p-value of ``peeled_p``.
    """
    pos = positive.distinct()
    use = pos.groupBy("complex").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pos = pos.join(F.broadcast(use), "complex")
    g = nodes.select("id", "ag", "bg")
    n_nodes = g.count()
    own = pos.join(g, "id")
    counts = [own.groupBy("complex", *c).agg(F.count("*").alias(x)) for c, x in ((["ag"], "ka"), (["bg"], "kb"), (["ag", "bg"], "kab"))]
    sizes = [g.groupBy(*c).agg(F.count("*").alias(x)) for c, x in ((["ag"], "sa"), (["bg"], "sb"), (["ag", "bg"], "sab"))]
    chance = own.join(counts[0], ["complex", "ag"]).join(counts[1], ["complex", "bg"]).join(counts[2], ["complex", "ag", "bg"]).join(sizes[0], "ag").join(sizes[1], "bg").join(sizes[2], ["ag", "bg"])
    k = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    chance = chance.join(k, "id", "left").na.fill(0, ["k"])
    share = F.try_divide(F.col("n") - F.col("ka") - F.col("kb") + F.col("kab"), F.lit(n_nodes) - F.col("sa") - F.col("sb") + F.col("sab"))
    expected = chance.groupBy("complex").agg(F.greatest(F.lit(1e-6), F.sum(F.col("k") * F.coalesce(share, F.lit(0.0)))).alias("expected_total_nbrs"))
    links = edges.select("src", "dst").join(pos.select(F.col("id").alias("src"), "complex"), "src").join(pos.select(F.col("id").alias("dst"), "complex"), ["dst", "complex"])
    near = links.groupBy("complex", "src").agg(F.count("*").alias("m")).groupBy("complex").agg(F.sum("m").alias("total_nbrs"), F.max("m").alias("max_nbrs"))
    out = use.join(expected, "complex").join(near, "complex", "left").na.fill(0, ["total_nbrs", "max_nbrs"])
    e, t = F.col("expected_total_nbrs"), F.col("total_nbrs")
    out = out.withColumn("log2_enrich", F.when(t > 0, F.log2(t / e)).when(e < 1, 0.0).otherwise(F.log2(0.5 / e)))
    p = peeled_p(pos, edges, nodes)
    return out.join(p, "complex").select("complex", F.col("n").alias("num_positive_clones"), "total_nbrs", "expected_total_nbrs", "max_nbrs", "log2_enrich", "pvalue")
