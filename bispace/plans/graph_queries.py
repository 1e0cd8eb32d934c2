"""Queries over neighbour graphs: agreement of graphs, features on neighbourhoods, biases, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bispace.operators import dense, graph_tests, neighbours
from bispace.plans.base import query
from bispace.plans.registry import GVG, NODES, SAME, _knn, _log10, _two_step
from bispace.session import work_table
from bispace.sources import adapters

FRACTIONS = [0.01, 0.1]
N = "(SELECT count(*) FROM nodes)"
GENES = [f"g{k}" for k in range(1, 33)]
SCORES = [f"s{k}" for k in range(1, 33)]


def _kept(spark, sf_dir, *spaces: str, fraction: float = 0.1) -> tuple:
    """Nodes and their graphs, each graph written once: it is used more than once."""
    n = adapters.nodes(spark, sf_dir)
    k = max(1, int(fraction * n.count()))
    return n, *(work_table(neighbours.exclusion_knn(n, s, k), f"knn-{s}") for s in spaces)


def _dense(spark, sf_dir, *spaces: str, fraction: float = 0.1) -> tuple:
    """The same with graphs that are summed over where they are found."""
    n = adapters.nodes(spark, sf_dir)
    k = max(1, int(fraction * n.count()))
    return n, *(dense.Nearest(n, s, k) for s in spaces)


def _scores(n: DataFrame):
    return n.select("id", F.col("tcr").alias("x")), SCORES


def _genes(n: DataFrame):
    return n.select("id", F.transform("gex", lambda v: F.greatest(v, F.lit(0.0))).alias("x")), GENES


_GENE_ROWS = "genes AS (SELECT id, 'g' || unnest(range(1, 33)) AS feature, unnest(list_transform(gex, lambda v: greatest(v, 0.0))) AS value FROM nodes)"
_SCORE_ROWS = "scores AS (SELECT id, 's' || unnest(range(1, 33)) AS feature, unnest(tcr) AS value FROM nodes)"

# ---- graph against graph -----------------------------------------------------------------------


def _named_ctes(text: str, names: str, suffix: str) -> str:
    """A CTE text with some of its names suffixed, to use it several times in one statement."""
    import re

    return re.sub(rf"\b({names})\b", lambda m: m[1] + suffix, text)


def _neighbour_test(g: str, t: str, suffix: str) -> str:
    text = f"""hit AS (SELECT g.src AS id, count(*) AS o, least(count(DISTINCT n.ag), count(DISTINCT n.bg)) AS g FROM {g} g JOIN {t} t USING (src, dst) JOIN nodes n ON n.id = g.dst GROUP BY g.src),
 ka AS (SELECT src AS id, count(*) AS a FROM {g} GROUP BY 1), kb AS (SELECT src AS id, count(*) AS b FROM {t} GROUP BY 1),
 tested AS (SELECT s.id, coalesce(o, 0) AS o, coalesce(g, 0) AS g, coalesce(a, 0) AS a, coalesce(b, 0) AS b, {N} AS n, {N} - same AS p FROM same s LEFT JOIN hit USING (id) LEFT JOIN ka USING (id) LEFT JOIN kb USING (id)), """
    return _named_ctes(text + _two_step("a", "b").replace("FROM t)", "FROM tested)"), "hit|ka|kb|tested|first|done", suffix)


def _cluster_test(e: str, c: str, suffix: str) -> str:
    text = f"""size AS (SELECT id, count(*) OVER (PARTITION BY {c}) - count(*) OVER (PARTITION BY {c}, ag) - count(*) OVER (PARTITION BY {c}, bg) + count(*) OVER (PARTITION BY {c}, ag, bg) AS b FROM nodes),
 hit AS (SELECT src AS id, count(*) AS o, least(count(DISTINCT d.ag), count(DISTINCT d.bg)) AS g FROM {e} JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst WHERE s.{c} = d.{c} GROUP BY src),
 ka AS (SELECT src AS id, count(*) AS a FROM {e} GROUP BY 1),
 tested AS (SELECT s.id, coalesce(o, 0) AS o, coalesce(g, 0) AS g, coalesce(a, 0) AS a, b, {N} AS n, {N} - same AS p FROM same s JOIN size USING (id) LEFT JOIN hit USING (id) LEFT JOIN ka USING (id)), """
    return _named_ctes(text + _two_step("a", "b").replace("FROM t)", "FROM tested)"), "size|hit|ka|tested|first|done", suffix)


_EDGES = ", ".join(f"{s}{k} AS (SELECT * FROM knn_{s} WHERE rank <= greatest(1, CAST(floor({f} * {N}) AS BIGINT)))" for s in ("gex", "tcr") for k, f in enumerate(FRACTIONS))
_ALL = ", ".join(x for k in range(2) for x in (_neighbour_test(f"gex{k}", f"tcr{k}", f"_n{k}"), _cluster_test(f"gex{k}", "ct", f"_g{k}"), _cluster_test(f"tcr{k}", "cg", f"_t{k}")))
_KINDS = {"n": "gex_nbr_vs_tcr_nbr", "g": "gex_nbr_vs_tcr_cluster", "t": "gex_cluster_vs_tcr_nbr"}
_TESTS = f"WITH {NODES}, {_knn('gex')}, {_knn('tcr')}, {SAME}, {_EDGES}, {_ALL}, tests AS (" + " UNION ALL ".join(f"SELECT id, {f}::DOUBLE AS nbr_frac, '{kind}' AS graph_overlap_type, o AS overlap, p_adj FROM done_{c}{k}" for k, f in enumerate(FRACTIONS) for c, kind in _KINDS.items()) + ")"


@query(_TESTS + " SELECT id, nbr_frac, graph_overlap_type, overlap, round(log10(p_adj), 4) AS log_p FROM tests WHERE p_adj <= 1")
def graph_vs_graph_full(spark, sf_dir):
    done = graph_tests.graph_vs_graph_nodes(adapters.nodes(spark, sf_dir), FRACTIONS)
    return done.where("p_adj <= 1").select("id", "nbr_frac", "graph_overlap_type", "overlap", _log10(F.col("p_adj")).alias("log_p"))


_SHARED = _TESTS.replace("CAST(embedding[33:64] AS DOUBLE[]) AS tcr", "CAST(list_concat(embedding[1:20], embedding[53:64]) AS DOUBLE[]) AS tcr")


@query(_SHARED + " SELECT id, nbr_frac, graph_overlap_type, overlap, round(log10(p_adj), 4) AS log_p FROM tests WHERE p_adj <= 1")
def graph_vs_graph_hits(spark, sf_dir):
    """As above, where the second space shares most of its places with the first, so that graphs agree."""
    n = adapters.nodes(spark, sf_dir)
    n = work_table(n.withColumn("tcr", F.concat(F.slice("gex", 1, 20), F.slice("tcr", 21, 12))), "nodes")
    done = work_table(graph_tests.graph_vs_graph_nodes(n, FRACTIONS), "tests")
    return done.where("p_adj <= 1").select("id", "nbr_frac", "graph_overlap_type", "overlap", _log10(F.col("p_adj")).alias("log_p"))


@query(_TESTS + f""", m AS (SELECT id, p_adj, p_adj / {N} AS p FROM tests), q AS (SELECT id, p_adj, p, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS q FROM m),
 f AS (SELECT id, p_adj, least(1.0, min(q) OVER (ORDER BY p DESC)) AS fdr FROM q) SELECT id, round(log10(min(p_adj)), 4) AS log_score, round(log10(greatest(1e-100, min(fdr))), 4) AS log_fdr FROM f GROUP BY id""")
def graph_scores_fdr(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = graph_tests.best_scores(work_table(graph_tests.graph_vs_graph_nodes(n, FRACTIONS), "tests"), n.count())
    return done.select("id", _log10(F.col("score")).alias("log_score"), _log10(F.col("fdr")).alias("log_fdr"))


def _stats(suffix: str, a: str, b: str, kind: str, f: float, repeats: int) -> tuple[str, str]:
    text = f"""ob AS (SELECT count(*) AS overlap FROM {a} JOIN {b} USING (src, dst)),
 ex AS (SELECT sum(x.k * y.k)::DOUBLE / ({N} - 1) AS expected FROM (SELECT src, count(*) AS k FROM {a} GROUP BY 1) x JOIN (SELECT src, count(*) AS k FROM {b} GROUP BY 1) y USING (src)),
 da AS (SELECT id, count(dst)::DOUBLE * {N} / (SELECT count(*) FROM {a}) AS x FROM nodes LEFT JOIN {a} ON dst = id GROUP BY id), db AS (SELECT id, count(dst)::DOUBLE * {N} / (SELECT count(*) FROM {b}) AS x FROM nodes LEFT JOIN {b} ON dst = id GROUP BY id),
 sa AS (SELECT var_samp(x) AS v, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skew, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS kurt FROM da, (SELECT avg(x) AS m FROM da)),
 sb AS (SELECT var_samp(x) AS v, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS skew, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) - 3 AS kurt FROM db, (SELECT avg(x) AS m FROM db)),
 co AS (SELECT corr(da.x, db.x) AS r FROM da JOIN db USING (id)),
 sh AS (SELECT p.rep, count(*) AS k FROM {b} JOIN perm p ON p.id = src JOIN perm q ON q.id = dst AND q.rep = p.rep JOIN {a} z ON z.src = p.too AND z.dst = q.too GROUP BY p.rep),
 ms AS (SELECT avg(coalesce(k, 0)) AS m, stddev_pop(coalesce(k, 0)) AS s FROM (SELECT unnest(range(1, {repeats + 1})) AS rep) LEFT JOIN sh USING (rep)),
 fi AS (SELECT power(10, 0.691433 * log10(expected) + 0.253497 * (log10(sa.v) + log10(sb.v)) - 0.340085) AS s FROM ex, sa, sb)"""
    names = "ob|ex|da|db|sa|sb|co|sh|ms|fi"
    row = f"""SELECT {f}::DOUBLE AS nbr_frac, '{kind}' AS graph_overlap_type, overlap, round(expected, 4) AS expected_overlap, round(ms.m, 4) AS overlap_mean, round(ms.s, 4) AS overlap_sdev, round((overlap - ms.m) / ms.s, 4) AS overlap_zscore,
 round((overlap - expected) / fi.s, 4) AS overlap_zscore_fitted, (SELECT count(*) FROM {a}) AS gex_edges, (SELECT count(*) FROM {b}) AS tcr_edges, round(sa.v, 6) AS gex_variance, round(sa.skew, 6) AS gex_skewness, round(sa.kurt, 6) AS gex_kurtosis,
 round(sb.v, 6) AS tcr_variance, round(sb.skew, 6) AS tcr_skewness, round(sb.kurt, 6) AS tcr_kurtosis, round(co.r, 6) AS indegree_r FROM ob, ex, sa, sb, co, ms, fi"""
    return _named_ctes(text, names, suffix), _named_ctes(row, names, suffix)


_REPEATS = 100
_CLUSTER_EDGES = ", ".join(f"clus_{c} AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b USING ({c}) WHERE a.ag <> b.ag AND a.bg <> b.bg)" for c in ("cg", "ct"))
_PERM = f"""slots AS (SELECT id AS too, row_number() OVER (ORDER BY id) AS slot FROM nodes), perm AS (SELECT rep, d.id, too FROM (SELECT rep, id, row_number() OVER (PARTITION BY rep ORDER BY md5(rep || '-' || id), id) AS slot FROM nodes, (SELECT unnest(range(1, {_REPEATS + 1})) AS rep)) d JOIN slots USING (slot))"""
_STAT = [_stats(f"_s{k}{j}", a, b, kind, f, _REPEATS) for k, f in enumerate(FRACTIONS) for j, (a, b, kind) in enumerate(((f"gex{k}", f"tcr{k}", _KINDS["n"]), (f"gex{k}", "clus_ct", _KINDS["g"]), ("clus_cg", f"tcr{k}", _KINDS["t"])))]


@query(f"WITH {NODES}, {_knn('gex')}, {_knn('tcr')}, {_EDGES}, {_CLUSTER_EDGES}, {_PERM}, " + ", ".join(c for c, _ in _STAT) + " " + " UNION ALL ".join(r for _, r in _STAT))
def graph_vs_graph_stats(spark, sf_dir):
    n, g, t = _kept(spark, sf_dir, "gex", "tcr")
    done = graph_tests.graph_vs_graph_stats(n, g, t, FRACTIONS, repeats=_REPEATS)
    r = lambda c, k: F.round(c, k)
    return done.select(
        "nbr_frac", "graph_overlap_type", "overlap", *(r(c, 4).alias(c) for c in ("expected_overlap", "overlap_mean", "overlap_sdev", "overlap_zscore", "overlap_zscore_fitted")), "gex_edges", "tcr_edges",
        *(r(f"{s}_indegree_{c}", 6).alias(f"{s}_{c}") for s in ("gex", "tcr") for c in ("variance", "skewness", "kurtosis")), r("indegree_correlation_r", 6).alias("indegree_r"),
    )


# ---- features on neighbourhoods ----------------------------------------------------------------
def _moments(edges: str, values: str, least: int = 3) -> str:
    """CTE tested (id, feature, n_fg, mean_fg, mean_bg, t, u) of closed neighbourhoods."""
    return f"""closed AS (SELECT src, dst FROM {edges} UNION SELECT src, src FROM {edges}), al AS (SELECT feature, count(*) AS m, sum(value) AS t, sum(value * value) AS tt FROM {values} GROUP BY 1),
 rk AS (SELECT id, feature, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM {values}),
 fg AS (SELECT src AS id, feature, count(*) AS n, sum(value) AS s, sum(value * value) AS ss, sum(rk) AS r FROM closed JOIN rk ON rk.id = dst GROUP BY ALL),
 tested AS (SELECT fg.id, feature, n AS n_fg, s / n AS mean_fg, (t - s) / (m - n) AS mean_bg, (s / n - (t - s) / (m - n)) / sqrt(greatest(1e-12, ss / n - (s / n) * (s / n)) / n + greatest(1e-12, (tt - ss) / (m - n) - ((t - s) / (m - n)) * ((t - s) / (m - n))) / (m - n)) AS t,
  CAST(r - n * (n + 1) / 2.0 AS DOUBLE) AS u FROM fg JOIN al USING (feature) WHERE n >= {least} AND m > n)"""


@query(f"WITH {NODES}, {_knn('gex', '10')}, {_SCORE_ROWS}, {_moments('knn_gex', 'scores')} SELECT id, feature, n_fg, round(t, 5) AS t, round(u, 1) AS u FROM tested")
def neighbourhood_feature_stats(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    packed, names = _scores(n)
    done = graph_tests.named(graph_tests.neighbourhood_tests(neighbours.exclusion_knn(n, "gex", 10), packed, 32), names)
    return done.select("id", "feature", "n_fg", F.round("t", 5).alias("t"), F.round("u", 1).alias("u"))


@query(f"""WITH {NODES}, {_knn('tcr', '10')}, {_GENE_ROWS}, {_moments('knn_tcr', 'genes')}, best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(t, 9) DESC, feature) AS r FROM tested)
 SELECT id, feature, n_fg, round(t, 5) AS t, round(log2((exp(mean_fg) - 1 + 1e-9) / (exp(mean_bg) - 1 + 1e-9)), 5) AS log2enr FROM best WHERE r <= 5""")
def neighbourhood_top_genes(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    packed, names = _genes(n)
    done = graph_tests.named(graph_tests.neighbourhood_tests(neighbours.exclusion_knn(n, "tcr", 10), packed, 32, alternative="greater"), names)
    best = done.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("t", 9)), "feature"))).where("r <= 5")
    return best.select("id", "feature", "n_fg", F.round("t", 5).alias("t"), F.round(graph_tests.log2_fold(F.col("mean_fg"), F.col("mean_bg")), 5).alias("log2enr"))


@query()
def gex_vs_scores(spark, sf_dir):
    n, g = _dense(spark, sf_dir, "gex")
    return graph_tests.scores_on_graph(g, *_scores(n), 1.0)


@query()
def tcr_vs_genes(spark, sf_dir):
    n, t = _dense(spark, sf_dir, "tcr")
    return graph_tests.genes_on_graph(t, *_genes(n), 1.0)


@query()
def graph_vs_features(spark, sf_dir):
    n, g, t = _dense(spark, sf_dir, "gex", "tcr")
    return graph_tests.graph_vs_features(n, {"gex": g, "tcr": t}, {"gex": "cg", "tcr": "ct"}, {"gex": _genes(n), "tcr": _scores(n)})


@query(f"""WITH {NODES}, {_SCORE_ROWS}, heads AS (SELECT cg, min(id) AS src FROM nodes GROUP BY 1), e AS (SELECT src, id AS dst FROM nodes JOIN heads USING (cg)), {_moments('e', 'scores')}
 SELECT id, feature, n_fg, round(t, 5) AS t, round(u, 1) AS u FROM tested""")
def cluster_feature_stats(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    packed, names = _scores(n)
    done = graph_tests.named(graph_tests.neighbourhood_tests(graph_tests.clusters_as_graph(n, "cg"), packed, 32), names)
    return done.select("id", "feature", "n_fg", F.round("t", 5).alias("t"), F.round("u", 1).alias("u"))


@query(f"""WITH {NODES}, {_knn('gex')}, closed AS (SELECT src, dst FROM knn_gex UNION SELECT src, src FROM knn_gex),
 top AS (SELECT * FROM (SELECT src, d.cg, d.ct, CAST(d.id % 7 = 0 AS INT) AS inv, count(*) OVER (PARTITION BY src) // 4 AS k, row_number() OVER (PARTITION BY src ORDER BY d.tcr[1] DESC, d.id) AS r FROM closed JOIN nodes d ON d.id = dst) WHERE r <= k),
 a AS (SELECT src, arg_max(cg, n * 1000 - cg) AS cg FROM (SELECT src, cg, count(*) AS n FROM top GROUP BY ALL) GROUP BY src), b AS (SELECT src, arg_max(ct, n * 1000 - ct) AS ct FROM (SELECT src, ct, count(*) AS n FROM top GROUP BY ALL) GROUP BY src)
 SELECT src AS id, count(*) AS n_top, a.cg AS gex_cluster, b.ct AS tcr_cluster, round(avg(inv), 6) AS invariant FROM top JOIN a USING (src) JOIN b USING (src) GROUP BY ALL""")
def top_quarter_consensus(spark, sf_dir):
    n, g = _kept(spark, sf_dir, "gex")
    done = graph_tests.top_quarter(g, n.select("id", F.col("tcr")[0].alias("value")), n.withColumn("invariant", (F.col("id") % 7 == 0).cast("int")))
    return done.withColumn("invariant", F.round("invariant", 6))


@query(f"""WITH {NODES}, {_knn('gex')}, k AS (SELECT *, max(rank) OVER (PARTITION BY src) AS k FROM knn_gex), w AS (SELECT *, CASE WHEN k > 1 THEN 1 + (1.0 / k - 1) * (rank - 1) / (k - 1) ELSE 1.0 END AS w FROM k),
 d AS (SELECT src AS id, round(sum(w * dist) / sum(w), 9) AS nndist FROM w GROUP BY src), o AS (SELECT id, row_number() OVER (ORDER BY nndist DESC, id) - 1 AS place FROM d) SELECT place AS id, round(ln(1 + id), 9) AS value FROM o""")
def density_positions(spark, sf_dir):
    _, g = _dense(spark, sf_dir, "gex")
    d = g.lengths([g.k]).select("id", F.round("nndist", 9).alias("nndist"))
    return graph_tests.density_positions(d).select("id", F.round("value", 9).alias("value"))


# ---- autocorrelation ---------------------------------------------------------------------------
def _z(edges: str, values: str) -> str:
    return f"""st AS (SELECT feature, avg(value) AS m, var_pop(value) AS v FROM {values} GROUP BY 1), h AS (SELECT a.feature, sum(a.value * b.value) AS xx, sum(b.value) AS xin FROM {edges} JOIN {values} a ON a.id = src JOIN {values} b ON b.id = dst AND b.feature = a.feature GROUP BY 1),
 ev AS (SELECT sum(CASE WHEN r.src IS NULL THEN 1 ELSE 2 END) AS v FROM {edges} k LEFT JOIN {edges} r ON r.src = k.dst AND r.dst = k.src), zz AS (SELECT feature, (xx - m * xin) / greatest(1e-9, st.v) / sqrt(ev.v) AS z FROM h JOIN st USING (feature), ev WHERE sqrt(st.v) >= 1e-6)"""


def _hot(space: str, values: str, c: str, name: str, suffix: str) -> str:
    rows = f"vals AS (SELECT * FROM {values} UNION ALL SELECT n.id, '{name}' || c.{c}, CAST(n.{c} = c.{c} AS INT)::DOUBLE FROM nodes n, (SELECT DISTINCT {c} FROM nodes) c)"
    return _named_ctes(f"{rows}, {_z(f'knn_{space}', 'vals')}", "vals|st|h|ev|zz", suffix)


@query(f"WITH {NODES}, {_knn('gex')}, {_knn('tcr')}, {_GENE_ROWS}, {_SCORE_ROWS}, {_hot('tcr', 'genes', 'cg', 'gex_cluster', '_a')}, {_hot('gex', 'scores', 'ct', 'tcr_cluster', '_b')} SELECT 'gex' AS feature_type, feature, round(z, 4) AS z FROM zz_a UNION ALL SELECT 'tcr', feature, round(z, 4) FROM zz_b")
def hotspot_full(spark, sf_dir):
    n, g, t = _dense(spark, sf_dir, "gex", "tcr")
    return graph_tests.hotspots(g, t, n, _genes(n), _scores(n), threshold=float("inf")).select("feature_type", "feature", F.round("z", 4).alias("z"))


@query(f"""WITH {NODES}, {_knn('gex', '10')}, {_knn('tcr', '10')}, s AS (SELECT src AS f, dst AS id FROM knn_tcr UNION SELECT id, id FROM nodes), vals AS (SELECT n.id, f.id AS feature, CAST(s.id IS NOT NULL AS INT)::DOUBLE AS value FROM nodes n CROSS JOIN nodes f LEFT JOIN s ON s.f = f.id AND s.id = n.id), {_z('knn_gex', 'vals')}
 SELECT feature AS id, round(z, 4) AS z FROM zz""")
def hotspot_neighbourhoods(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    g, t = (work_table(neighbours.exclusion_knn(n, s, 10), f"knn-{s}") for s in ("gex", "tcr"))
    return graph_tests.hotspot_neighbourhoods(t, g, n).select("id", F.round("z", 4).alias("z"))


# ---- batches, clusters, subsets ----------------------------------------------------------------
_FREQ = "ev AS (SELECT CAST(user_id AS BIGINT) AS id, event_type AS feature, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) AS f FROM events GROUP BY user_id, event_type), freq AS (SELECT n.id, b.feature, coalesce(f, 0.0) AS value FROM nodes n CROSS JOIN (SELECT DISTINCT feature FROM ev) b LEFT JOIN ev ON ev.id = n.id AND ev.feature = b.feature)"
_BIAS = f"WITH {NODES}, {_knn('tcr', '10')}, {_FREQ}, {_moments('knn_tcr', 'freq', 1)}, st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM freq GROUP BY 1), biased AS (SELECT id, feature AS batch, (mean_fg - m) / sd AS zscore, mean_fg, u FROM tested JOIN st USING (feature) WHERE sd >= 1e-6)"


def _batches(spark, sf_dir):
    from bispace.operators.cells import batch_frequency

    n = adapters.nodes(spark, sf_dir)
    f = batch_frequency(adapters.batches(spark, sf_dir)).select(F.col("clone").cast("long").alias("id"), "batch", "frequency")
    return n, neighbours.exclusion_knn(n, "tcr", 10), f


@query(_BIAS + " SELECT id, batch, round(zscore, 6) AS zscore, round(mean_fg, 6) AS nbrs_mean, round(u, 1) AS u FROM biased WHERE zscore >= 0.01")
def batch_bias(spark, sf_dir):
    n, e, f = _batches(spark, sf_dir)
    return graph_tests.batch_bias(e, f, n).select("id", "batch", F.round("zscore", 6).alias("zscore"), F.round("nbrs_mean", 6).alias("nbrs_mean"), F.round("u", 1).alias("u"))


@query("WITH RECURSIVE " + _BIAS.removeprefix("WITH ") + """, own AS (SELECT DISTINCT id, batch, ct FROM biased JOIN nodes USING (id) WHERE zscore >= 0.5), one AS (SELECT DISTINCT a.id AS a, b.id AS b FROM knn_tcr JOIN own a ON a.id = src JOIN own b ON b.id = dst AND b.batch = a.batch AND b.ct = a.ct),
 link AS (SELECT a, b FROM one UNION SELECT b, a FROM one), reach AS (SELECT id AS node, id AS c FROM own UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.node) SELECT node AS id, min(c) AS "group" FROM reach GROUP BY node""")
def batch_bias_groups(spark, sf_dir):
    n, e, f = _batches(spark, sf_dir)
    e = work_table(e, "knn-tcr")
    return graph_tests.bias_groups(work_table(graph_tests.batch_bias(e, f, n).where("zscore >= 0.5"), "biased"), e, n, "ct")


@query()
def cluster_interactions(spark, sf_dir):
    found = graph_tests.cluster_interactions(adapters.receptors(spark, sf_dir).select(F.col("cg").alias("a"), F.col("ct").alias("b"), "ag", "bg"))
    return spark.createDataFrame([tuple(r.values()) for r in found], "a long, b long, pvalue double, overlap long, expected double, margin_a long, margin_b long")


@query(f"""WITH {NODES}, {_knn('gex')}, {_knn('tcr', '30')}, c AS (SELECT g.src, g.dst, 0.5 * ((g.rank - 1) + coalesce(t.rank - 1, 0.5 * {N})) / {N} AS dist FROM knn_gex g LEFT JOIN knn_tcr t USING (src, dst))
 SELECT src, dst, round(CAST(dist AS DOUBLE), 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM c) WHERE rank <= 10""")
def combined_neighbours(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    k = n.count()
    g, t = neighbours.exclusion_knn(n, "gex", max(1, int(0.1 * k))), neighbours.exclusion_knn(n, "tcr", 30)
    return graph_tests.combined_neighbours(g, t, k).select("src", "dst", F.round("dist", 9).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {NODES}, {_knn('gex')}, s AS (SELECT avg(tcr[1]) AS m, stddev_pop(tcr[1]) AS sd FROM nodes), a AS (SELECT src AS id, (any_value(o.tcr[1]) + sum(n.tcr[1])) / (count(*) + 1) AS avg FROM knn_gex JOIN nodes n ON n.id = dst JOIN nodes o ON o.id = src GROUP BY src)
 SELECT id FROM nodes JOIN a USING (id), s WHERE (avg - m) / sd >= 0.1 AND (tcr[1] - m) / sd >= 0.1""")
def extreme_subset(spark, sf_dir):
    n, g = _dense(spark, sf_dir, "gex")
    return graph_tests.extreme_subset(n.select("id", F.col("tcr")[0].alias("value")), g, max(1, int(0.1 * n.count())), 0.1)


@query()
def random_score_threshold(spark, sf_dir):
    n, g = _kept(spark, sf_dir, "gex")
    return spark.createDataFrame([(graph_tests.random_threshold(g, n),)], "threshold double")


# ---- correlations and ranks --------------------------------------------------------------------
@query(f"WITH {NODES}, {_GENE_ROWS}, {_SCORE_ROWS} SELECT g.feature AS gene, s.feature AS feature, round(corr(g.value, s.value), 6) AS r FROM genes g JOIN scores s USING (id) GROUP BY ALL HAVING count(*) FILTER (g.value <> 0) >= 5 AND corr(g.value, s.value) IS NOT NULL")
def gene_feature_correlations(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return graph_tests.feature_correlations(_genes(n), _scores(n)).select("gene", "feature", F.round("r", 6).alias("r"))


@query(f"WITH {NODES} SELECT a.id, round(corr(list_distance(a.gex, b.gex), list_distance(a.tcr, b.tcr)), 6) AS r FROM nodes a JOIN nodes b ON a.ag <> b.ag AND a.bg <> b.bg GROUP BY a.id")
def distance_correlations(spark, sf_dir):
    return graph_tests.distance_correlations(adapters.nodes(spark, sf_dir), "gex", "tcr").select("id", F.round("r", 6).alias("r"))


@query(f"""WITH {NODES}, {_SCORE_ROWS}, x AS (SELECT feature, value, cg = 0 AS sub FROM scores JOIN nodes USING (id)), s AS (SELECT feature, count(*) FILTER (sub) AS n1, count(*) FILTER (NOT sub) AS n2, avg(value) FILTER (sub) AS m1, avg(value) FILTER (NOT sub) AS m2, var_pop(value) FILTER (sub) AS v1, var_pop(value) FILTER (NOT sub) AS v2 FROM x GROUP BY 1)
 SELECT feature, n1 AS n_in, round(m1, 6) AS mean_in, round(m2, 6) AS mean_out, round((m1 - m2) / sqrt((n1 * v1 + n2 * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 5) AS t FROM s""")
def distinctive_features(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    packed = n.select("id", F.col("tcr").alias("x"), (F.col("cg") == 0).alias("sub"))
    return graph_tests.distinctive_features(packed, SCORES, F.col("sub")).select("feature", "n_in", F.round("mean_in", 6).alias("mean_in"), F.round("mean_out", 6).alias("mean_out"), F.round("t", 5).alias("t"))


@query(f"""WITH {NODES}, {_GENE_ROWS}, r AS (SELECT cg AS "group", feature, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature, value) AS k FROM genes JOIN nodes USING (id)),
 ties AS (SELECT feature, sum(k * k - 1)::DOUBLE AS ties, count(*) AS m, sum(value) AS s FROM r GROUP BY 1), g AS (SELECT "group", feature, count(*) AS n, sum(rk) AS rs, sum(value) AS s FROM r GROUP BY ALL)
 SELECT "group", feature, n AS n_in, round((rs - n * (m + 1) / 2.0) / sqrt(n * (m - n) / 12.0 * (m + 1 - ties / (m * (m - 1)))), 5) AS z, round(log2((exp(g.s / n) - 1 + 1e-9) / (exp((ties.s - g.s) / (m - n)) - 1 + 1e-9)), 5) AS log2fc FROM g JOIN ties USING (feature)""")
def rank_genes(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = graph_tests.rank_features(*_genes(n), n.select("id", F.col("cg").alias("group")))
    return done.select("group", "feature", "n_in", F.round("z", 5).alias("z"), F.round("log2fc", 5).alias("log2fc"))


@query(f"""WITH {NODES}, {_knn('gex')}, a AS (SELECT src AS id, (any_value(o.tcr[1]) + sum(n.tcr[1])) / (count(*) + 1) AS x, (any_value(o.tcr[2]) + sum(n.tcr[2])) / (count(*) + 1) AS y FROM knn_gex JOIN nodes n ON n.id = dst JOIN nodes o ON o.id = src GROUP BY src)
 SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(y, x), 6) AS r, count(*) AS n FROM a""")
def averaged_regression(spark, sf_dir):
    n, g = _dense(spark, sf_dir, "gex")
    own = n.select("id", F.slice("tcr", 1, 2).alias("own"))
    near = g.sums(own, ["own"]).select("id", "n", F.col("own").alias("s"))
    mean = lambda k: (F.col("own")[k] + F.coalesce(F.col("s")[k], F.lit(0.0))) / (F.coalesce("n", F.lit(0)) + 1)
    a = own.join(near, "id", "left").select(mean(0).alias("x"), mean(1).alias("y"))
    return a.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.corr("y", "x"), 6).alias("r"), F.count("*").alias("n"))


@query(f"""WITH {NODES}, {_SCORE_ROWS}, own AS (SELECT id, cg, ct FROM nodes WHERE gex[1] > 0), pairs AS (SELECT cg, ct, min(id) AS src, count(*) AS n FROM own GROUP BY ALL), e AS (SELECT src, id AS dst FROM own JOIN pairs USING (cg, ct)), {_moments('e', 'scores', 5)}
 SELECT cg, ct, feature, n_fg AS num_fg, round(t, 5) AS ttest_stat, round(mean_fg, 6) AS mean_fg FROM tested JOIN pairs ON src = id""")
def bicluster_features(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    done = graph_tests.bicluster_features(n, F.col("gex")[0] > 0, *_scores(n))
    return done.select("cg", "ct", "feature", "num_fg", F.round("ttest_stat", 5).alias("ttest_stat"), F.round("mean_fg", 6).alias("mean_fg"))


@query(f"""WITH {NODES} SELECT id, 'tcr' AS kind, 's3' AS feature, round(tcr[3], 6) AS value FROM nodes UNION ALL SELECT id, 'gex', 'g2', round(greatest(gex[2], 0.0), 6) FROM nodes UNION ALL SELECT id, 'gex', 'gex_cluster4', CAST(cg = 4 AS INT)::DOUBLE FROM nodes UNION ALL SELECT id, 'tcr', 'clone_sizes', round(ln(1 + 1 + id % 7), 6) FROM nodes""")
def raw_feature_scores(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir).withColumn("clone_size", 1 + F.col("id") % 7)
    wanted = [("tcr", "s3"), ("gex", "g2"), ("gex", "gex_cluster4"), ("tcr", "clone_sizes")]
    return graph_tests.raw_feature_scores({"gex": _genes(n), "tcr": _scores(n)}, wanted, n).withColumn("value", F.round("value", 6))


@query(GVG + " SELECT id, round(sqrt(greatest(0.0, -log10(greatest(p_adj, 1e-300)))), 4) AS mark FROM done")
def significance_marks(spark, sf_dir):
    from bispace.functions.scores import significance

    n, a, b = _kept(spark, sf_dir, "gex", "tcr")
    return neighbours.graph_vs_graph(a, b, n).select("id", F.round(significance(F.col("p_adj")), 4).alias("mark"))
