"""Gene names and gene tables: repair, families, representatives, cluster names, feature kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions.scores import trim_allele
from bispace.operators.components import connected_components
from bispace.operators.sequences import CLOSE

#: Prefixes of receptor genes by kind of receptor, their constant regions, and odd names.
VDJ_PREFIXES = {"ab": ("trav", "trbv", "traj", "trbj", "trbd"), "gd": ("trav", "trdv", "traj", "trdj", "trgv", "trgj", "tcrg-", "trdd"), "ig": ("ighv", "iglv", "igkv", "ighj", "iglj", "igkj", "ighd")}
CONSTANT_PREFIXES = {"ab": ("trac", "trbc"), "gd": ("trdc", "trgc"), "ig": ("ighc", "iglc", "igkc")}
VDJ_NAMES = {"ab": ("5830405F06Rik", "TRD-AS1", "ENSG00000251002", "ENSG00000288882", "ENSG00000289938"), "gd": (), "ig": ("AC233755.1", "AC233755.2", "CH17-224D4.2", "IGLL5")}
#: Feature types of expression tables.
EXPRESSION, ANTIBODY = "Gene Expression", "Antibody Capture"


def is_vdj_gene(gene: Column, kind: str, constant: bool = False) -> Column:
    """Whether an expressed gene belongs to the receptors of a kind; prefixes ignore case, odd names don't."""
    if kind not in VDJ_PREFIXES:
        raise ValueError(f"unknown kind of receptor: {kind}")
    prefixes = VDJ_PREFIXES[kind] + (CONSTANT_PREFIXES[kind] if constant else ())
    return F.lower(gene).rlike("^(" + "|".join(prefixes) + ")") | gene.isin(*VDJ_NAMES[kind])


def v_family(gene: Column) -> Column:
    """Chain letter, V and the family's number: AV12 of TRAV12-1*01."""
    return F.concat(F.substring(gene, 3, 1), F.lit("V"), F.regexp_extract(gene, r"^...V(\d+)", 1).cast("int").cast("string"))


def repaired(names: DataFrame, known: DataFrame) -> DataFrame:
    """(gene, fixed, is_known): each distinct name of ``names`` (gene) as the known table (gene) has it.

    A known name stays; one without an allele gets its lowest; a V gene whose ``/DV`` lost its slash or
    has another sign there gets it back. What still isn't known stays as it is.
    """
    given = names.select("gene").distinct()
    known = known.select("gene").distinct()
    lowest = known.groupBy(F.substring_index("gene", "*", 1).alias("stem")).agg(F.min("gene").alias("by_allele"))
    at = F.instr("gene", "DV")
    v = (F.substring("gene", 4, 1) == "V") & (at > 0)
    put = lambda cut: F.when(v, F.concat(F.expr(f"substring(gene, 1, instr(gene, 'DV') - {cut})"), F.lit("/"), F.expr("substring(gene, instr(gene, 'DV'))")))
    tries = given.select("gene", put(1).alias("with_slash"), put(2).alias("other_sign"))
    hit = lambda c, out: known.select(F.col("gene").alias(c)).withColumn(out, F.lit(True))
    t = tries.join(known.withColumn("exact", F.lit(True)), "gene", "left").join(lowest.withColumnRenamed("stem", "gene"), "gene", "left")
    t = t.join(hit("with_slash", "s1"), "with_slash", "left").join(hit("other_sign", "s2"), "other_sign", "left")
    fixed = F.when(F.col("exact"), F.col("gene")).when(F.col("by_allele").isNotNull() & ~F.col("gene").contains("*"), F.col("by_allele")).when(F.col("s1"), F.col("with_slash")).when(F.col("s2"), F.col("other_sign")).otherwise(F.col("gene"))
    done = t.select("gene", fixed.alias("fixed"), (F.coalesce("exact", "s1", "s2", F.lit(False)) | (F.col("by_allele").isNotNull() & ~F.col("gene").contains("*"))).alias("is_known"))
    return done


def representatives(genes: DataFrame) -> DataFrame:
    """(gene, rep, mm1_rep, count_rep) of V genes (gene, chain, loops): the smallest gene of equal loops,
    the smallest of the closure of near loops, and the gene without its allele.

    Near: no gap or stop against a letter, at most one differing letter in the first two loops, and
    that a similar one (letter distance up to 3), at most two in all. A gene table has some hundred rows.
    """
    rep = F.min("gene").over(Window.partitionBy("chain", "loops"))
    a, b = (genes.select("chain", F.col("gene").alias(g), F.col("loops").alias(l)) for g, l in (("g1", "l1"), ("g2", "l2")))
    pairs = a.join(b, "chain").where("g1 < g2 and length(l1) = length(l2)")
    each = F.zip_with(F.split("l1", ""), F.split("l2", ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    last = F.length("l1") - F.instr(F.reverse("l1"), " ") + 1  # where the last loop begins
    close = [x for p, d in CLOSE.items() if d <= 3 for x in (p, p[::-1])]
    diff = F.filter(F.transform(each, lambda p, k: F.struct(p["x"].alias("x"), p["y"].alias("y"), (k + 1).alias("k"))), lambda p: p["x"] != p["y"])
    t = pairs.withColumn("diff", diff).withColumn("last", last)
    odd = F.exists("diff", lambda p: p["x"].isin(".", "*", " ") | p["y"].isin(".", "*", " "))
    early = F.filter("diff", lambda p: p["k"] < F.col("last"))
    near = t.withColumn("early", early).where(~odd & (F.size("early") <= 1) & (F.size("diff") <= 2) & F.forall("early", lambda p: F.concat(p["x"], p["y"]).isin(*close)))
    ids = genes.select("gene").distinct().withColumn("n", F.xxhash64("gene"))
    links = near.select("g1", "g2").unionByName(genes.select(rep.alias("g1"), F.col("gene").alias("g2")).where("g1 <> g2"))
    linked = links.join(ids.select(F.col("gene").alias("g1"), F.col("n").alias("u")), "g1").join(ids.select(F.col("gene").alias("g2"), F.col("n").alias("v")), "g2")
    part = ids.join(connected_components(linked, "u", "v"), F.col("n") == F.col("node"), "left").select("gene", F.coalesce("component", "n").alias("part"))
    smallest = part.groupBy("part").agg(F.min("gene").alias("mm1_rep"))
    return genes.select("gene", rep.alias("rep")).join(part, "gene").join(smallest, "part").select("gene", "rep", "mm1_rep", trim_allele(F.col("gene")).alias("count_rep"))


def mapped(names: Column, table: Column) -> Column:
    """The distinct representatives of an array of genes, sorted; unknown genes are left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda g: F.try_element_at(table, g)), lambda g: g.isNotNull())))


def top_genes(hits: Column) -> Column:
    """Genes with the greatest score of ``gene:score;gene:score``, sorted; a repeated gene has its last score."""
    pairs = F.transform(F.split(hits, ";"), lambda h: F.struct(F.split(h, ":")[0].alias("g"), F.split(h, ":")[1].cast("int").alias("s")))
    last = F.filter(pairs, lambda p, k: ~F.exists(F.slice(pairs, k + 2, F.greatest(F.size(pairs) - k - 1, F.lit(0))), lambda q: q["g"] == p["g"]))
    top = F.array_max(F.transform(last, lambda p: p["s"]))
    return F.array_sort(F.transform(F.filter(last, lambda p: p["s"] == top), lambda p: p["g"]))


def cluster_names(receptors: DataFrame, cluster: str = "ct", organism: str = "human") -> DataFrame:
    """(cluster, name): number and commonest V family, upper case from three quarters of the cluster's
    receptors, lower from half; else, for people, families 14, 38 (and 19) of alpha together; else the
    number. Ties of families go to the first by name."""
    r = receptors.select(F.col(cluster).alias("cluster"), v_family(F.col("va")).alias("a"), v_family(F.col("vb")).alias("b"))
    n = r.groupBy("cluster").agg(F.count("*").alias("n"))
    counts = r.select("cluster", F.explode(F.array("a", "b")).alias("f")).groupBy("cluster", "f").agg(F.count("*").alias("k"))
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("f").isin(*names), F.col("k"))), F.lit(0))
    top = counts.groupBy("cluster").agg(F.min(F.struct((-F.col("k")).alias("m"), "f")).alias("top"), of("AV14", "AV38").alias("c2"), of("AV14", "AV38", "AV19").alias("c3"))
    t = top.join(n, "cluster").select("cluster", "n", (-F.col("top.m")).alias("k"), F.col("top.f").alias("f"), "c2", "c3")
    number, part = F.col("cluster").cast("string"), lambda c, s: F.col(c) + (1e-3 if c == "k" else 0.0) >= s * F.col("n")
    name = F.when(part("k", 0.75), F.concat_ws("_", number, "f")).when(part("k", 0.5), F.concat_ws("_", number, F.lower("f")))
    if organism == "human":
        for share, tag in ((0.75, "AV14"), (0.5, "av14")):
            for c, sign in (("c2", "+"), ("c3", "++")):
                name = name.when(part(c, share), F.concat(number, F.lit(f"_{tag}{sign}")))
    return t.select("cluster", name.otherwise(number).alias("name"))


def complex_names(features: DataFrame) -> DataFrame:
    """(feature, short, long) of peptide complexes among features (feature, gene_id, feature_type):
    antibody features without TotalSeq in their name. Short: three letters of the HLA, four of the
    peptide and its length."""
    f = features.where((F.col("feature_type") == ANTIBODY) & ~F.col("feature").contains("TotalSeq"))
    long_ = F.when(F.col("gene_id").startswith("NR("), F.replace(F.expr("substring(gene_id, 4)"), F.lit(")"), F.lit(""))).otherwise(F.col("gene_id"))
    parts = F.split(long_, "_")
    return f.select("feature", F.concat(F.substring(parts[0], 1, 3), F.lit("_"), F.substring(parts[1], 1, 4), F.length(parts[1]).cast("string")).alias("short"), long_.alias("long"))


def label_colors(counts: DataFrame, colors: list[str]) -> DataFrame:
    """(label, rank, color) of labels (label, n): by count, ties by name from the last; beyond the list the last colour."""
    from bispace.operators.windows import running_sum

    ranked = running_sum(counts, [], [F.desc("n"), F.desc("label")], F.lit(1), "rank")
    return ranked.select("label", "rank", F.element_at(F.array(*map(F.lit, colors)), F.least("rank", F.lit(len(colors))).cast("int")).alias("color"))
