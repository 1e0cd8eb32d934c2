"""Queries whose methods walk, draw or iterate, and those over peptide complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.operators import complexes, junctions, modularity, motifs, neighbours, reductions, subsets, trees
from bispace.plans.base import query
from bispace.plans.receptor_queries import _v
from bispace.plans.registry import NODES, _knn
from bispace.session import work_table
from bispace.sources import adapters

# ---- peptide complexes: counts of the absolute second half of a node's vector, large ones only --------
_CX = "cx AS (SELECT id, 'c' || unnest(range(1, 7)) AS complex, unnest(list_transform(tcr[1:6], lambda v: ln(1 + floor(abs(v) * 300)))) AS x FROM nodes)"
_POS = "pos AS (SELECT id, complex FROM (SELECT id, complex, x, row_number() OVER w AS r, lead(x, 1, 0.0) OVER w AS y FROM cx WINDOW w AS (PARTITION BY id ORDER BY x DESC, complex)) WHERE r = 1 AND x - y >= 0.4 AND exp(x) - exp(y) >= 3)"


def _complexes(n: DataFrame) -> DataFrame:
    rows = n.select("id", F.posexplode(F.slice("tcr", 1, 6)).alias("p", "v"))
    return rows.select("id", F.concat(F.lit("c"), (F.col("p") + 1).cast("string")).alias("complex"), F.log1p(F.floor(F.abs("v") * 300)).alias("x"))


@query(f"WITH {NODES}, {_CX}, {_POS} SELECT id, complex FROM pos")
def complex_positives(spark, sf_dir):
    return complexes.positives(_complexes(adapters.nodes(spark, sf_dir)), 0.4)


@query(f"WITH {NODES}, {_CX} SELECT id, complex FROM cx WHERE x >= 3.5")
def complex_above(spark, sf_dir):
    return complexes.above(_complexes(adapters.nodes(spark, sf_dir)), 3.5)


@query(f"""WITH {NODES}, {_CX}, {_POS}, m AS (SELECT bg AS clone, complex, avg(x) AS mean FROM cx JOIN nodes USING (id) GROUP BY ALL), d AS (SELECT clone, complex, mean - CASE WHEN row_number() OVER w = 1 THEN lead(mean, 1, 0.0) OVER w ELSE max(mean) OVER (PARTITION BY clone) END AS log_delta FROM m WINDOW w AS (PARTITION BY clone ORDER BY mean DESC, complex)),
 s AS (SELECT bg AS clone, count(*) AS clone_size FROM nodes GROUP BY 1) SELECT bg AS clone, complex, count(*) AS n_positive, clone_size, round(log_delta, 6) AS log_delta FROM pos JOIN nodes USING (id) JOIN s ON s.clone = bg JOIN d ON d.clone = bg AND d.complex = pos.complex GROUP BY bg, pos.complex, clone_size, log_delta""".replace("SELECT bg AS clone, complex, count(*) AS n_positive", "SELECT bg AS clone, pos.complex, count(*) AS n_positive"))
def complex_clones(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = complexes.clone_enrichment(n.select(F.col("bg").alias("clone"), "id"), _complexes(n), 0.4)
    return done.select("clone", "complex", "n_positive", "clone_size", F.round("log_delta", 6).alias("log_delta"))


_PAIRS = f"""WITH {NODES}, {_knn('gex', '20')}, {_CX}, {_POS}, use AS (SELECT complex, count(*) AS n FROM pos GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT pos.id, complex, ag, bg FROM pos JOIN use USING (complex) JOIN nodes USING (id)),
 ch AS (SELECT a.complex, a.id, (SELECT count(*) FROM p b WHERE b.complex = a.complex AND b.ag <> a.ag AND b.bg <> a.bg)::DOUBLE / (SELECT count(*) FROM nodes b WHERE b.ag <> a.ag AND b.bg <> a.bg) AS share, (SELECT count(*) FROM knn_gex WHERE src = a.id) AS k FROM p a),
 ex AS (SELECT complex, greatest(1e-6, sum(k * share)) AS expected FROM ch GROUP BY 1), nb AS (SELECT a.complex, a.id, count(*) AS m FROM knn_gex JOIN p a ON a.id = src JOIN p b ON b.id = dst AND b.complex = a.complex GROUP BY ALL), t AS (SELECT complex, CAST(sum(m) AS BIGINT) AS total, max(m) AS most FROM nb GROUP BY 1)"""


@query(_PAIRS + " SELECT complex, n AS num_positive_clones, coalesce(total, 0) AS total_nbrs, round(expected, 6) AS expected_total_nbrs, coalesce(most, 0) AS max_nbrs, round(CASE WHEN total > 0 THEN log2(total / expected) WHEN expected < 1 THEN 0 ELSE log2(0.5 / expected) END, 5) AS log2_enrich FROM use JOIN ex USING (complex) LEFT JOIN t USING (complex)")
def complexes_on_graph(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    e = work_table(neighbours.exclusion_knn(n, "gex", 20), "knn-gex")
    done = complexes.complexes_on_graph(complexes.positives(_complexes(n), 0.4), e, n)
    return done.select("complex", "num_positive_clones", "total_nbrs", F.round("expected_total_nbrs", 6).alias("expected_total_nbrs"), "max_nbrs", F.round("log2_enrich", 5).alias("log2_enrich"))


# ---- motifs, junctions, trees ------------------------------------------------------------------
@query()
def enriched_motifs(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir)
    seqs = lambda rows: rows.select("id", F.col("cdr3b").alias("seq"))
    found = motifs.enriched_motifs(seqs(r.where("cg = 0")), seqs(r.where("cg <> 0")))
    return spark.createDataFrame([("+".join(m.cores), m.p, m.enrich, m.fg, m.bg) for m in found], "motif string, pval_adj double, enrich double, fg_count long, bg_count long")


def _junctions(spark, sf_dir):
    genes = junctions.Genes.of(adapters.junction_genes(spark, sf_dir).collect())  # some hundred genes
    return adapters.junction_chains(spark, sf_dir), genes


@query()
def junction_parse(spark, sf_dir):
    return junctions.parse_junctions(*_junctions(spark, sf_dir)).select("id", "junction.*")


@query()
def better_alleles(spark, sf_dir):
    return junctions.better_alleles(*_junctions(spark, sf_dir)).select("id", "v", "j")


@query()
def resampled_chains(spark, sf_dir):
    chains, genes = _junctions(spark, sf_dir)
    return junctions.resampled_chains(work_table(junctions.parse_junctions(chains, genes), "junctions"), 2 * chains.count())


@query()
def back_translate(spark, sf_dir):
    chains, genes = _junctions(spark, sf_dir)
    return junctions.back_translate(chains.drop("nt"), genes).select("id", "cdr3", "nt")


@query()
def greedy_radius(spark, sf_dir):
    return trees.greedy_clusters(adapters.receptors(spark, sf_dir), _v(spark, sf_dir), 77)


# ---- components and clusters -------------------------------------------------------------------
@query()
def kernel_pca(spark, sf_dir):
    done = reductions.kernel_components(adapters.receptors(spark, sf_dir), _v(spark, sf_dir), 10)
    return done.select("id", F.transform("kpc", lambda x: F.round(x, 6)).alias("kpc"))


@query()
def label_clusters(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return reductions.label_clusters(neighbours.exclusion_knn(n, "gex", 10), n)


@query()
def modularity_clusters(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return modularity.modularity_clusters(neighbours.exclusion_knn(n, "gex", 10), n)


@query()
def clustered_votes(spark, sf_dir):
    """CD4 and CD8 by clusters that are made here, from the neighbour graph."""
    n = adapters.nodes(spark, sf_dir)
    g = lambda k: F.col("gex")[k]
    cells = n.select("id", F.col("id").alias("cell"), F.col("bg").alias("clone"), g(0).alias("c4"), g(1).alias("c8a"), g(2).alias("c8b"))
    tagged = subsets.marker_tags(subsets.with_clusters(cells, neighbours.exclusion_knn(n, "gex", 10)), "cluster", "c4", ("c8a", "c8b"))
    return subsets.clone_vote(tagged).select("id", "cluster", F.col("cd4_or_cd8").alias("tag"), "subset")


@query()
def mixed_components(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = reductions.mixed_components(n.select("id", F.col("gex").alias("x")), 32, n.select("id", F.col("tcr").alias("x")), 32, 5, 3)
    return done.select("id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))
