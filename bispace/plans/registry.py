"""Queries of the engine's own operators over the driver's whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bispace.functions.stats import benjamini_hochberg
from bispace.operators import cells, dense, graph_tests, neighbours, receptors, sequences
from bispace.operators.components import connected_components
from bispace.plans.base import QUERIES, SQL, query
from bispace.session import work_table
from bispace.sources import adapters

FRACTION = 0.1

# ---- SQL fragments shared by the oracles -------------------------------------------------------
NODES = """nodes AS (SELECT vec_id AS id, CAST(embedding[1:32] AS DOUBLE[]) AS gex, CAST(embedding[33:64] AS DOUBLE[]) AS tcr,
 CAST(label AS BIGINT) AS cg, CAST((label + vec_id % 3) % 10 AS BIGINT) AS ct, vec_id // 2 AS ag, vec_id % 250 AS bg FROM embeddings)"""
SAME = "same AS (SELECT id, count(*) OVER (PARTITION BY ag) + count(*) OVER (PARTITION BY bg) - count(*) OVER (PARTITION BY ag, bg) AS same FROM nodes)"


def _knn(space: str, k: str = "greatest(1, CAST(floor(0.1 * (SELECT count(*) FROM nodes)) AS BIGINT))") -> str:
    return f"""knn_{space} AS (SELECT src, dst, dist, rank FROM (SELECT a.id AS src, b.id AS dst, round(list_distance(a.{space}, b.{space}), 9) AS dist,
 row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.{space}, b.{space}), 9), b.id) AS rank
 FROM nodes a JOIN nodes b ON a.ag <> b.ag AND a.bg <> b.bg) WHERE rank <= {k})"""


def _tail(o: str, p: str, a: str, b: str) -> str:
    c = lambda n, k: f"(lgamma({n}+1.0)-lgamma({k}+1.0)-lgamma({n}-({k})+1.0))"
    low = f"greatest({o}, {a}+{b}-{p}, 0)"
    term = f"exp((CASE WHEN j = j THEN {c(a, 'j')} END) + {c(f'({p}-{a})', f'({b}-j)')} - {c(p, b)})"
    lists = f"list_sum(list_transform(range({low}, least({a}, {b}) + 1), lambda j: {term}))"
    return f"coalesce(least(1.0, {lists}), 0.0)"


def _two_step(a: str, b: str) -> str:
    return f"""first AS (SELECT *, CASE WHEN o > 0 AND o > {a} * {b} / p THEN n * {_tail('o', 'p', a, b)} ELSE n END AS p1 FROM t),
 done AS (SELECT id, o, greatest(1e-100, CASE WHEN p1 <= 1.0 AND g < o THEN n * {_tail('g', 'p', f'({a}-(o-g))', f'({b}-(o-g))')} ELSE p1 END) AS p_adj FROM first)"""


GVG = f"""WITH {NODES}, {_knn('gex')}, {_knn('tcr')}, {SAME},
 hit AS (SELECT g.src AS id, count(*) AS o, least(count(DISTINCT n.ag), count(DISTINCT n.bg)) AS g FROM knn_gex g JOIN knn_tcr t USING (src, dst) JOIN nodes n ON n.id = g.dst GROUP BY g.src),
 ka AS (SELECT src AS id, count(*) AS a FROM knn_gex GROUP BY 1), kb AS (SELECT src AS id, count(*) AS b FROM knn_tcr GROUP BY 1),
 t AS (SELECT s.id, coalesce(o, 0) AS o, coalesce(g, 0) AS g, coalesce(a, 0) AS a, coalesce(b, 0) AS b, (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM nodes) - same AS p
  FROM same s LEFT JOIN hit USING (id) LEFT JOIN ka USING (id) LEFT JOIN kb USING (id)), {_two_step('a', 'b')}"""


def _log10(p: Column) -> Column:
    return F.round(F.log10(F.greatest(p, F.lit(1e-100))), 4)


def _graph(spark: SparkSession, sf_dir: str, *spaces: str) -> tuple:
    n = adapters.nodes(spark, sf_dir)
    k = max(1, int(FRACTION * n.count()))
    return n, *(neighbours.exclusion_knn(n, s, k) for s in spaces)


def _nearest(spark: SparkSession, sf_dir: str, space: str) -> tuple:
    """The same graph without its edges."""
    n = adapters.nodes(spark, sf_dir)
    return n, dense.Nearest(n, space, max(1, int(FRACTION * n.count())))


def _edges(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


# ---- graphs ------------------------------------------------------------------------------------
_EDGE = "SELECT src, dst, round(dist, 6) AS dist, rank FROM knn_"


@query(f"WITH {NODES}, {_knn('gex')} {_EDGE}gex")
def knn_gex(spark, sf_dir):
    return _edges(_graph(spark, sf_dir, "gex")[1])


@query(f"WITH {NODES}, {_knn('tcr')} {_EDGE}tcr")
def knn_tcr(spark, sf_dir):
    return _edges(_graph(spark, sf_dir, "tcr")[1])


@query(f"WITH {NODES}, {_knn('gex', '10')} {_EDGE}gex")
def knn_pruned(spark, sf_dir):
    from bispace.operators.pruned import pruned_knn

    return _edges(pruned_knn(adapters.nodes(spark, sf_dir), "gex", 10, block=128)[0])


@query(f"WITH {NODES}, {_knn('gex')}, f AS (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE]) AS frac) SELECT frac, src, count(*) AS k, round(max(dist), 6) AS reach FROM knn_gex, f WHERE rank <= greatest(1, floor(frac * (SELECT count(*) FROM nodes))) GROUP BY ALL")
def knn_multi_frac(spark, sf_dir):
    n, g = _nearest(spark, sf_dir, "gex")
    count = n.count()
    ks = {f: max(1, int(f * count)) for f in (0.01, 0.1)}
    found = work_table(g.lengths(sorted(set(ks.values()))), "lengths")
    parts = [found.where(F.col("k") == k).select(F.col("id").alias("src"), F.col("n").alias("k"), F.round("reach", 6).alias("reach"), F.lit(f).alias("frac")) for f, k in ks.items()]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {NODES}, {_knn('gex')}, k AS (SELECT *, max(rank) OVER (PARTITION BY src) AS k FROM knn_gex),
 w AS (SELECT *, CASE WHEN k > 1 THEN 1 + (1.0 / k - 1) * (rank - 1) / (k - 1) ELSE 1.0 END AS w FROM k) SELECT src AS id, round(sum(w * dist) / sum(w), 6) AS nndist FROM w GROUP BY src""")
def nn_density(spark, sf_dir):
    g = _nearest(spark, sf_dir, "gex")[1]
    return g.lengths([g.k]).select("id", F.round("nndist", 6).alias("nndist"))


@query(GVG + " SELECT id, o AS overlap FROM done")
def graph_overlap(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    met = dense.agreement(n, ("gex", "tcr"), [max(1, int(FRACTION * n.count()))], ("cg", "ct"), wanted=("both",))
    return n.select("id").join(met.select("id", F.col("both").alias("overlap")), "id", "left").na.fill(0, ["overlap"])


@query(GVG + " SELECT id, o AS overlap, round(log10(p_adj), 4) AS log_p FROM done")
def graph_vs_graph_score(spark, sf_dir):
    done = graph_tests.graph_vs_graph_nodes(adapters.nodes(spark, sf_dir), [FRACTION], kinds=graph_tests.KINDS[:1])
    return done.select("id", "overlap", _log10(F.col("p_adj")).alias("log_p"))


_GVC = f"""WITH {NODES}, {_knn('gex')}, {SAME},
 size AS (SELECT id, count(*) OVER (PARTITION BY cg) - count(*) OVER (PARTITION BY cg, ag) - count(*) OVER (PARTITION BY cg, bg) + count(*) OVER (PARTITION BY cg, ag, bg) AS b FROM nodes),
 hit AS (SELECT src AS id, count(*) AS o, least(count(DISTINCT d.ag), count(DISTINCT d.bg)) AS g FROM knn_gex JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst WHERE s.cg = d.cg GROUP BY src),
 ka AS (SELECT src AS id, count(*) AS a FROM knn_gex GROUP BY 1),
 t AS (SELECT s.id, coalesce(o, 0) AS o, coalesce(g, 0) AS g, coalesce(a, 0) AS a, b, (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM nodes) - same AS p
  FROM same s JOIN size USING (id) LEFT JOIN hit USING (id) LEFT JOIN ka USING (id)), {_two_step('a', 'b')} SELECT id, o AS overlap, round(log10(p_adj), 4) AS log_p FROM done"""


@query(_GVC)
def graph_vs_cluster(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = graph_tests.graph_vs_graph_nodes(n, [FRACTION], spaces=("gex", "gex"), clusters=("cg", "cg"), kinds=graph_tests.KINDS[1:2])
    return done.select("id", "overlap", _log10(F.col("p_adj")).alias("log_p"))


@query(GVG + """, m AS (SELECT id, p_adj / (SELECT count(*) FROM nodes) AS p, rank() OVER (ORDER BY p_adj DESC) AS r FROM done),
 q AS (SELECT id, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM m) SELECT id, round(log10(greatest(1e-100, least(1.0, min(q) OVER (ORDER BY p DESC)))), 4) AS log_fdr FROM q""")
def bh_fdr(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    tests = work_table(graph_tests.graph_vs_graph_nodes(n, [FRACTION], kinds=graph_tests.KINDS[:1]), "tests")
    p = tests.select("id", (F.col("p_adj") / n.count()).alias("p"))
    return benjamini_hochberg(p, "p").select("id", _log10(F.col("fdr")).alias("log_fdr"))


@query(f"WITH {NODES}, {_knn('gex')}, d AS (SELECT id, count(dst) AS d FROM nodes LEFT JOIN knn_gex ON dst = id GROUP BY id) SELECT count(*) AS n, round(avg(d), 6) AS mean, round(var_samp(d), 6) AS variance, max(d) AS most FROM d")
def graph_indegree_stats(spark, sf_dir):
    d = _nearest(spark, sf_dir, "gex")[1].indegree()
    return d.agg(F.count("*").alias("n"), F.round(F.avg("indegree"), 6).alias("mean"), F.round(F.var_samp("indegree"), 6).alias("variance"), F.max("indegree").alias("most"))


_LONG = "vals AS (SELECT id, unnest(range(1, 33)) AS feature, unnest(tcr) AS value FROM nodes)"


def _values(n: DataFrame) -> DataFrame:
    return n.select("id", F.posexplode("tcr").alias("p", "value")).select("id", (F.col("p") + 1).cast("long").alias("feature"), "value")


@query(f"""WITH {NODES}, {_knn('gex')}, {_LONG}, stat AS (SELECT feature, avg(value) AS m, var_pop(value) AS v FROM vals GROUP BY 1),
 h AS (SELECT a.feature, sum(a.value * b.value) AS xx, sum(b.value) AS xin FROM knn_gex JOIN vals a ON a.id = src JOIN vals b ON b.id = dst AND b.feature = a.feature GROUP BY 1),
 e AS (SELECT sum(CASE WHEN r.src IS NULL THEN 1 ELSE 2 END) AS v FROM knn_gex k LEFT JOIN knn_gex r ON r.src = k.dst AND r.dst = k.src)
 SELECT feature, round(CASE WHEN stat.v = 0 THEN 0 ELSE (xx - m * xin) / greatest(1e-9, stat.v) / sqrt(e.v) END, 4) AS z FROM h JOIN stat USING (feature), e""")
def hotspot_z(spark, sf_dir):
    n, g = _nearest(spark, sf_dir, "gex")
    return dense.hotspot(g, n.select("id", F.col("tcr").alias("x"))).select((F.col("pos") + 1).cast("long").alias("feature"), F.round("z", 4).alias("z"))


@query(f"""WITH {NODES}, {_knn('gex', '10')}, {_LONG}, closed AS (SELECT src, dst FROM knn_gex UNION ALL SELECT id, id FROM nodes),
 fg AS (SELECT src AS id, feature, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM closed JOIN vals ON vals.id = dst GROUP BY ALL),
 al AS (SELECT feature, count(*) AS m, sum(value) AS t, sum(value * value) AS tt FROM vals GROUP BY 1)
 SELECT fg.id, feature, n AS n_fg, round((s / n - (t - s) / (m - n)) / sqrt(greatest(1e-12, ss / n - (s / n) * (s / n)) / n + greatest(1e-12, (tt - ss) / (m - n) - ((t - s) / (m - n)) * ((t - s) / (m - n))) / (m - n)), 5) AS t
 FROM fg JOIN al USING (feature) WHERE n >= 3 AND m > n""")
def welch_t(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return neighbours.neighbourhood_moments(neighbours.exclusion_knn(n, "gex", 10), _values(n)).select("id", "feature", "n_fg", F.round("t", 5).alias("t"))


@query(f"""WITH {NODES}, {_LONG}, r AS (SELECT feature, n.cg = 0 AS f, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM vals JOIN nodes n USING (id))
 SELECT feature, CAST(sum(f::INT) AS BIGINT) AS n1, count(*) - CAST(sum(f::INT) AS BIGINT) AS n2, CAST(round(sum(CASE WHEN f THEN r ELSE 0 END) - sum(f::INT) * (sum(f::INT) + 1) / 2.0, 1) AS DOUBLE) AS u FROM r GROUP BY 1""")
def mwu_u_statistic(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    rows = _values(n).join(n.select("id", (F.col("cg") == 0).alias("f")), "id")
    return neighbours.mann_whitney_u(rows, ["feature"], "f", "value").select("feature", "n1", "n2", F.round("u", 1).alias("u"))


@query(f"WITH {NODES}, {_knn('gex')}, s AS (SELECT src AS id, sum(n.tcr[1]) AS s, count(*) AS k FROM knn_gex JOIN nodes n ON n.id = dst GROUP BY 1) SELECT id, round((tcr[1] + coalesce(s, 0)) / (coalesce(k, 0) + 1), 6) AS avg FROM nodes LEFT JOIN s USING (id)")
def nbr_average(spark, sf_dir):
    n, e = _graph(spark, sf_dir, "gex")
    return neighbours.neighbour_average(e, n.select("id", F.col("tcr")[0].alias("value"))).select("id", F.round("avg", 6).alias("avg"))


@query(f"""WITH RECURSIVE {NODES}, {_knn('gex', '2')}, link AS (SELECT src AS a, dst AS b FROM knn_gex UNION SELECT dst, src FROM knn_gex),
 reach AS (SELECT a AS node, a AS c FROM link UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.node) SELECT node, min(c) AS component FROM reach GROUP BY node""")
def components_nearest(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return connected_components(neighbours.exclusion_knn(n, "gex", 2)).select("node", "component")


# ---- cells and features ------------------------------------------------------------------------
CELLS = "counts AS (SELECT l_orderkey AS cell, l_suppkey AS feature, l_quantity AS value FROM lineitem)"
ONE = "one AS (SELECT cell, feature, sum(value) AS value FROM counts GROUP BY ALL), x AS (SELECT cell, feature, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell)) AS x FROM one)"


@query(f"""WITH {CELLS}, e AS (SELECT cell FROM counts GROUP BY 1 HAVING count(DISTINCT feature) >= 2), k AS (SELECT * FROM counts WHERE cell IN (FROM e)),
 f AS (SELECT feature FROM k GROUP BY 1 HAVING count(DISTINCT cell) >= 3), g AS (SELECT * FROM k WHERE feature IN (FROM f))
 SELECT cell, count(DISTINCT feature) AS n_features, sum(value) AS total, round(sum(CASE WHEN feature % 10 = 0 THEN value ELSE 0 END) / sum(value), 9) AS mito_share FROM g GROUP BY 1
 HAVING count(DISTINCT feature) < 7 AND sum(CASE WHEN feature % 10 = 0 THEN value ELSE 0 END) / sum(value) < 0.5""")
def qc_filter(spark, sf_dir):
    kept = cells.qc_filter(adapters.cell_gene(spark, sf_dir), F.col("feature") % 10 == 0, 2, 7, 0.5, 3)
    return kept.select("cell", "n_features", "total", F.round("mito_share", 9).alias("mito_share"))


@query(f"WITH {CELLS}, {ONE} SELECT cell, feature, round(x, 6) AS x FROM x")
def normalize_log1p(spark, sf_dir):
    return cells.normalize_log1p(adapters.cell_gene(spark, sf_dir)).select("cell", "feature", F.round("x", 6).alias("x"))


@query(f"""WITH {CELLS}, {ONE}, n AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM counts), s AS (SELECT feature, sum(exp(x) - 1) AS s, sum((exp(x) - 1) * (exp(x) - 1)) AS ss FROM x GROUP BY 1)
 SELECT feature, round(ln(1 + s / n), 6) AS mean, round(ln((ss - n * (s / n) * (s / n)) / (n - 1) / (s / n)), 6) AS dispersion FROM s, n""")
def hvg_dispersion(spark, sf_dir):
    counts = adapters.cell_gene(spark, sf_dir)
    done = cells.dispersion(cells.normalize_log1p(counts), counts.select("cell").distinct().count())
    return done.select("feature", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"))


@query(f"""WITH {NODES}, d AS (SELECT a.bg AS clone, a.id AS cell, sum(list_distance(a.gex, b.gex)) AS total, avg(list_distance(a.gex, b.gex) ** 2) AS d2, count(*) AS size FROM nodes a JOIN nodes b USING (bg) GROUP BY ALL)
 SELECT clone, cell, size, round(sqrt(d2), 6) AS variation FROM d QUALIFY row_number() OVER (PARTITION BY clone ORDER BY round(total, 9), cell) = 1""")
def clone_medoid(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir).select(F.col("bg").alias("clone"), F.col("id").alias("cell"), F.col("gex").alias("v"))
    return cells.clone_medoid(n).select("clone", "cell", "size", F.round("variation", 6).alias("variation"))


@query("SELECT user_id AS clone, event_type AS batch, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS frequency FROM events GROUP BY user_id, event_type")
def batch_frequency(spark, sf_dir):
    return cells.batch_frequency(adapters.batches(spark, sf_dir)).select("clone", "batch", "n", F.round("frequency", 9).alias("frequency"))


@query(f"WITH {NODES}, n AS (SELECT cg AS a, ct AS b, least(count(DISTINCT ag), count(DISTINCT bg)) AS n FROM nodes GROUP BY ALL) SELECT a, b, n, CAST(sum(n) OVER (PARTITION BY a) AS BIGINT) AS margin_a, CAST(sum(n) OVER (PARTITION BY b) AS BIGINT) AS margin_b FROM n")
def cluster_contingency(spark, sf_dir):
    return cells.cluster_contingency(adapters.nodes(spark, sf_dir).select(F.col("cg").alias("a"), F.col("ct").alias("b"), "ag", "bg"))


@query("SELECT DISTINCT p_brand, p_type, dense_rank() OVER (ORDER BY p_brand, p_type) - 1 AS group_id FROM part")
def chain_group_ids(spark, sf_dir):
    return cells.dense_group_ids(adapters.table(spark, sf_dir, "part").select("p_brand", "p_type"), ["p_brand", "p_type"], "group_id").distinct().withColumn("group_id", F.col("group_id").cast("long"))


# ---- receptors ---------------------------------------------------------------------------------
CONTIGS = """contigs AS (SELECT o_custkey AS clone, l_orderkey AS barcode, CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'B' END AS ab, concat_ws('|', p_brand, p_type, p_name) AS chain,
 CAST(l_quantity AS BIGINT) AS umis, l_linestatus = 'O' AS productive FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
 umis AS (SELECT clone, ab, chain, CAST(sum(umis) AS BIGINT) AS umis FROM contigs WHERE productive GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY clone, ab ORDER BY umis DESC, chain) AS rank FROM umis),
 size AS (SELECT clone, count(DISTINCT barcode) AS clone_size FROM contigs GROUP BY 1)"""


@query(f"WITH {CONTIGS} SELECT clone, ab, chain, umis, rank FROM top WHERE rank <= 2")
def top_chain_per_clone(spark, sf_dir):
    return receptors.top_chains(receptors.chain_umis(adapters.contigs(spark, sf_dir)), 2).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {CONTIGS}, c AS (SELECT clone, max(chain) FILTER (ab = 'A' AND rank = 1) AS chain_a, max(chain) FILTER (ab = 'A' AND rank = 2) AS chain_a2, max(chain) FILTER (ab = 'B' AND rank = 1) AS chain_b,
 count(*) FILTER (ab = 'A') AS num_alphas, count(*) FILTER (ab = 'B') AS num_betas FROM top GROUP BY 1) SELECT clone, chain_a, chain_a2, chain_b, num_alphas, num_betas, clone_size FROM c JOIN size USING (clone) WHERE chain_a IS NOT NULL AND chain_b IS NOT NULL""")
def clone_table(spark, sf_dir):
    return receptors.clone_table(adapters.contigs(spark, sf_dir))


@query(f"WITH {CONTIGS} SELECT a.chain AS chain_a, b.chain AS chain_b, CAST(sum(clone_size) AS BIGINT) AS cells FROM umis a JOIN umis b USING (clone) JOIN size USING (clone) WHERE a.ab = 'A' AND b.ab = 'B' GROUP BY ALL")
def pairing_counts(spark, sf_dir):
    return receptors.pairing_counts(adapters.contigs(spark, sf_dir))


@query(f"WITH {CONTIGS} SELECT clone || '-' || s AS clone, s AS batch, count(*) AS n, count(DISTINCT barcode) AS barcodes FROM contigs, (SELECT unnest([0, 1]) AS s) WHERE (s = 0) = productive GROUP BY ALL")
def merge_samples_union(spark, sf_dir):
    c = adapters.contigs(spark, sf_dir)
    return receptors.merge_samples([c.where("productive"), c.where("not productive")]).groupBy("clone", "batch").agg(F.count("*").alias("n"), F.countDistinct("barcode").alias("barcodes"))


# ---- sequences of whole texts ------------------------------------------------------------------
def _whole(spark, sf_dir, parts=None):
    return adapters.windows(spark, sf_dir, "documents", "doc_id", parts), adapters.windows(spark, sf_dir, "benchmark", "item_id")


def _met(spark, sf_dir):
    """As ``_whole``, with the documents dealt out, since each of their windows meets all of the benchmark's."""
    return _whole(spark, sf_dir, max(64, 4 * spark.sparkContext.defaultParallelism))


def _repeat(spark, sf_dir) -> bool:
    """Whether texts share a key, so that windows of several are one."""
    keys = (("documents", "doc_id"), ("benchmark", "item_id"))
    return any(not adapters.table(spark, sf_dir, t).groupBy(k).count().where("count > 1").isEmpty() for t, k in keys)


@query()
def radius_matches_whole(spark, sf_dir):
    m = sequences.radius_windows(*_met(spark, sf_dir), 72)
    return m.select(F.col("i.id").alias("i"), F.col("i.pos").alias("i_pos"), F.col("j.id").alias("j"), F.col("j.pos").alias("j_pos"), "d")


@query()
def match_count_score_whole(spark, sf_dir):
    sides = _met(spark, sf_dir)
    done = sequences.match_score(sequences.radius_windows(*sides, 96), 48.0) if _repeat(spark, sf_dir) else sequences.window_match_score(*sides, 96, 48.0)
    return done.withColumn("soft", F.round("soft", 4))


@query()
def background_convolution_whole(spark, sf_dir):
    docs, db = _met(spark, sf_dir)
    pairs = max(1, db.where("length(seq) >= 5").count() ** 2)
    if _repeat(spark, sf_dir):
        m = sequences.radius_windows(docs, db, 96)
        done = sequences.background(m, m, pairs, 96).select("id.*", F.col("dist").cast("long").alias("dist"), "freq")
    else:
        done = sequences.window_background(docs, db, pairs, 96)
    return done.select("id", "pos", "dist", F.round(F.col("freq") * 1e6, 6).alias("freq_ppm"))


@query()
def strict_match_whole(spark, sf_dir):
    db = adapters.runs(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("item_id"), "pos", "seq")
    there = adapters.runs(spark, sf_dir, "documents", "doc_id").join(F.broadcast(db.select("seq").distinct()), "seq", "left_semi")
    return sequences.strict_match(db, there.select("id", "seq").distinct(), "seq").select("item_id", "pos", "seq", "ids")


@query()
def anti_merge_whole(spark, sf_dir):
    docs, db = (w.select("id", "pos", "seq") for w in _whole(spark, sf_dir))
    return sequences.anti_merge(db, docs, "seq").select("id", "pos", "seq")


@query()
def letter_counts_whole(spark, sf_dir):
    return sequences.letter_counts(_whole(spark, sf_dir)[0])


@query()
def pwm_whole(spark, sf_dir):
    return sequences.pwm_by_length(_whole(spark, sf_dir)[0]).select("len", "pos", "letter", F.round("freq", 9).alias("freq"))


@query()
def motif_core_counts_whole(spark, sf_dir):
    return sequences.motif_cores(_whole(spark, sf_dir)[0])


from bispace.plans import file_queries, graph_queries, more_queries, receptor_queries, table_queries  # noqa: E402, F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
