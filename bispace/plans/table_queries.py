"""Queries over cells, clones, genes and receptor scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions import scores
from bispace.operators import aggregates, cells, clones, genes, sequences, subsets
from bispace.plans.base import query
from bispace.plans.receptor_queries import DB, GENES, R
from bispace.plans.registry import CELLS, NODES, ONE
from bispace.sources import adapters

# ---- receptors with some invariant ones --------------------------------------------------------
_MORE = {
    "va": "CASE WHEN id % 11 = 0 THEN 'TRAV1-2*01' WHEN id % 13 = 0 THEN 'TRAV10*01' WHEN id % 17 = 0 THEN 'TRAV11*01' ELSE va END", "ja": "CASE WHEN id % 11 = 0 THEN 'TRAJ33*01' WHEN id % 13 = 0 OR id % 17 = 0 THEN 'TRAJ18*01' ELSE ja END",
    "vb": "CASE WHEN id % 13 = 0 THEN 'TRBV25-1*01' ELSE vb END",
}
INV = "inv AS (SELECT id, cdr3a, cdr3b, jb, cg, ct, clone_size, " + ", ".join(f"{e} AS {c}" for c, e in _MORE.items()) + " FROM r)"


def _invariant(spark, sf_dir) -> DataFrame:
    return adapters.receptors(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _MORE.items()}).select("id", "cdr3a", "cdr3b", "jb", "cg", "ct", "clone_size", "va", "ja", "vb")


_MAIT = "(va LIKE 'TRAV1-2%' AND (ja LIKE 'TRAJ33%' OR ja LIKE 'TRAJ20%' OR ja LIKE 'TRAJ12%') AND length(cdr3a) = 12)"
_INKT = "(va LIKE 'TRAV10%' AND ja LIKE 'TRAJ18%' AND length(cdr3a) IN (14, 15, 16) AND vb LIKE 'TRBV25%')"
_MOUSE = "((va LIKE 'TRAV1*%' AND ja LIKE 'TRAJ33%' AND length(cdr3a) = 12) OR (va LIKE 'TRAV11%' AND ja LIKE 'TRAJ18%' AND length(cdr3a) = 15))"


@query(f"WITH {R}, {INV} SELECT id, {_MAIT} AS mait, {_INKT} AS inkt, {_MAIT} OR {_INKT} AS invariant, {_MOUSE} AS invariant_mouse FROM inv")
def invariant_receptors(spark, sf_dir):
    r, c = _invariant(spark, sf_dir), F.col
    return r.select("id", scores.is_mait(c("va"), c("ja"), c("cdr3a")).alias("mait"), scores.is_inkt(c("va"), c("ja"), c("cdr3a"), c("vb")).alias("inkt"), scores.is_invariant(c("va"), c("ja"), c("cdr3a"), c("vb")).alias("invariant"), scores.is_invariant(c("va"), c("ja"), c("cdr3a"), c("vb"), "mouse").alias("invariant_mouse"))


@query(f"WITH {R}, {INV} SELECT id, va, vb FROM inv WHERE NOT ({_MAIT} OR {_INKT}) AND NOT contains(va, 'AV2') AND NOT contains(vb, 'AV2') AND NOT contains(va, 'V7*') AND NOT contains(vb, 'V7*') AND cg NOT IN (1, 3) AND id NOT IN (SELECT s_suppkey FROM supplier)")
def receptor_filters(spark, sf_dir):
    r = subsets.without_invariant(_invariant(spark, sf_dir), "human")
    r = subsets.without_clusters(subsets.without_v_genes(r, ["AV2", "V7*"]), "cg", [1, 3])
    bad = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("barcode"))
    return subsets.at_least(subsets.without_barcodes(r, bad, "id"), 15, "clones").select("id", "va", "vb")


_PREFIX = ["TRAV", "TRBV", "TRAJ", "TRBJ", "TRBD", "TRAC", "TRBC", "IGHV", "IGKJ", "IGHC", "TRDV", "TRGJ", "TCRG-", "TRDC", "CD", "TRA", "Trav", "Ighd", "IGLL", "TRD-AS"]
_GENE = f"gene AS (SELECT p_partkey AS id, [{', '.join(repr(p) for p in _PREFIX)}][1 + p_partkey % {len(_PREFIX)}] || (p_size % 7) AS g FROM part)"


@query(f"""WITH {_GENE} SELECT id, regexp_matches(lower(g), '^(trav|trbv|traj|trbj|trbd)') OR g IN ('5830405F06Rik', 'TRD-AS1', 'ENSG00000251002', 'ENSG00000288882', 'ENSG00000289938') AS ab,
 regexp_matches(lower(g), '^(trav|trdv|traj|trdj|trgv|trgj|tcrg-|trdd|trdc|trgc)') AS gd_constant, regexp_matches(lower(g), '^(ighv|iglv|igkv|ighj|iglj|igkj|ighd)') OR g IN ('AC233755.1', 'AC233755.2', 'CH17-224D4.2', 'IGLL5') AS ig FROM gene""")
def vdj_genes(spark, sf_dir):
    g = adapters.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.element_at(F.array(*map(F.lit, _PREFIX)), (F.col("p_partkey") % len(_PREFIX) + 1).cast("int")), (F.col("p_size") % 7).cast("string")).alias("g"))
    return g.select("id", genes.is_vdj_gene(F.col("g"), "ab").alias("ab"), genes.is_vdj_gene(F.col("g"), "gd", True).alias("gd_constant"), genes.is_vdj_gene(F.col("g"), "ig").alias("ig"))


@query("SELECT l_orderkey AS cell, l_suppkey AS feature, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 = 0 GROUP BY ALL")
def feature_type_split(spark, sf_dir):
    kind = F.when(F.col("s_nationkey") % 3 == 0, genes.ANTIBODY).otherwise(genes.EXPRESSION)
    types = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature"), kind.alias("feature_type"))
    return adapters.cell_gene(spark, sf_dir).join(subsets.by_feature_type(types, genes.ANTIBODY), "feature").groupBy("cell", "feature").agg(F.sum("value").alias("value"))


# ---- genes -------------------------------------------------------------------------------------
@query(f"""WITH {GENES}, gv AS (SELECT gene FROM genes UNION ALL SELECT 'TRAV' || n_nationkey || '/DV' || n_nationkey || '*01' FROM nation), q AS (SELECT DISTINCT unnest(['TRAV' || n_nationkey, 'TRBV' || (n_nationkey * 3), 'TRAV' || n_nationkey || 'DV' || n_nationkey || '*01', 'TRAV' || n_nationkey || '-DV' || n_nationkey || '*01', 'TRAV' || (n_nationkey + 1) || '*01']) AS gene FROM nation),
 t AS (SELECT q.gene, (SELECT min(gene) FROM gv WHERE gv.gene LIKE q.gene || '*%') AS low, substring(q.gene, 1, instr(q.gene, 'DV') - 1) || '/' || substring(q.gene, instr(q.gene, 'DV')) AS s1, substring(q.gene, 1, instr(q.gene, 'DV') - 2) || '/' || substring(q.gene, instr(q.gene, 'DV')) AS s2 FROM q),
 f AS (SELECT gene, CASE WHEN gene IN (SELECT gene FROM gv) THEN gene WHEN low IS NOT NULL THEN low WHEN instr(gene, 'DV') > 0 AND s1 IN (SELECT gene FROM gv) THEN s1 WHEN instr(gene, 'DV') > 0 AND s2 IN (SELECT gene FROM gv) THEN s2 ELSE gene END AS fixed FROM t) SELECT gene, fixed, fixed IN (SELECT gene FROM gv) AS is_known FROM f""")
def gene_repair(spark, sf_dir):
    n = adapters.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    known = adapters.genes(spark, sf_dir).select("gene").unionByName(n.selectExpr("concat('TRAV', n, '/DV', n, '*01') as gene"))
    asked = n.selectExpr("explode(array(concat('TRAV', n), concat('TRBV', n * 3), concat('TRAV', n, 'DV', n, '*01'), concat('TRAV', n, '-DV', n, '*01'), concat('TRAV', n + 1, '*01'))) as gene")
    return genes.repaired(asked, known)


@query(f"WITH {GENES} SELECT gene, min(gene) OVER (PARTITION BY chain, loops) AS rep, split_part(gene, '*', 1) AS count_rep FROM genes")
def gene_representatives(spark, sf_dir):
    return genes.representatives(adapters.genes(spark, sf_dir)).drop("mm1_rep")


_HITS = "id || ':' || (id % 5) || ';' || va || ':' || (id % 3 + 2) || ';' || vb || ':4'"


@query(f"WITH {R}, h AS (SELECT id, unnest([[CAST(id AS VARCHAR), CAST(id % 5 AS VARCHAR)], [va, CAST(id % 3 + 2 AS VARCHAR)], [vb, '4']]) AS p FROM r), m AS (SELECT id, p[1] AS g, CAST(p[2] AS INT) AS s, max(CAST(p[2] AS INT)) OVER (PARTITION BY id) AS top FROM h) SELECT id, string_agg(g, ',' ORDER BY g) AS top FROM m WHERE s = top GROUP BY id")
def blast_top_genes(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir)
    hits = F.concat_ws(";", F.concat_ws(":", F.col("id").cast("string"), (F.col("id") % 5).cast("string")), F.concat_ws(":", "va", (F.col("id") % 3 + 2).cast("string")), F.concat_ws(":", "vb", F.lit("4")))
    return r.select("id", F.array_join(genes.top_genes(hits), ",").alias("top"))


@query(f"""WITH {R}, f AS (SELECT ct, 'AV' || CAST(regexp_extract(va, 'V([0-9]+)', 1) AS INT) AS f FROM r UNION ALL SELECT ct, 'BV' || CAST(regexp_extract(vb, 'V([0-9]+)', 1) AS INT) FROM r), n AS (SELECT ct, count(*) AS n FROM r GROUP BY 1), c AS (SELECT ct, f, count(*) AS k FROM f GROUP BY ALL),
 t AS (SELECT ct, f, k, row_number() OVER (PARTITION BY ct ORDER BY k DESC, f) AS r, sum(CASE WHEN f IN ('AV14', 'AV38') THEN k ELSE 0 END) OVER (PARTITION BY ct) AS c2, sum(CASE WHEN f IN ('AV14', 'AV38', 'AV19') THEN k ELSE 0 END) OVER (PARTITION BY ct) AS c3 FROM c)
 SELECT ct AS cluster, CASE WHEN k + 1e-3 >= 0.75 * n THEN ct || '_' || f WHEN k + 1e-3 >= 0.5 * n THEN ct || '_' || lower(f) WHEN c2 >= 0.75 * n THEN ct || '_AV14+' WHEN c3 >= 0.75 * n THEN ct || '_AV14++' WHEN c2 >= 0.5 * n THEN ct || '_av14+' WHEN c3 >= 0.5 * n THEN ct || '_av14++' ELSE ct || '' END AS name FROM t JOIN n USING (ct) WHERE r = 1""")
def cluster_names(spark, sf_dir):
    return genes.cluster_names(adapters.receptors(spark, sf_dir))


@query(f"""WITH {R}, f AS (SELECT 'f' || id || CASE WHEN id % 4 = 0 THEN '_TotalSeq' ELSE '' END AS feature, CASE WHEN id % 3 = 0 THEN 'NR(' || 'A0201_' || cdr3a || ')_x' ELSE 'B0702_' || cdr3b || '_y' END AS g, id % 5 AS k FROM r)
 SELECT feature, split_part(CASE WHEN g LIKE 'NR(%' THEN replace(substring(g, 4), ')', '') ELSE g END, '_', 1)[1:3] || '_' || split_part(CASE WHEN g LIKE 'NR(%' THEN replace(substring(g, 4), ')', '') ELSE g END, '_', 2)[1:4] || length(split_part(CASE WHEN g LIKE 'NR(%' THEN replace(substring(g, 4), ')', '') ELSE g END, '_', 2)) AS short,
 CASE WHEN g LIKE 'NR(%' THEN replace(substring(g, 4), ')', '') ELSE g END AS long FROM f WHERE k <> 0 AND NOT contains(feature, 'TotalSeq')""")
def complex_names(spark, sf_dir):
    i, text = F.col("id"), F.col("id").cast("string")
    f = adapters.receptors(spark, sf_dir).select(
        F.concat(F.lit("f"), text, F.when(i % 4 == 0, "_TotalSeq").otherwise("")).alias("feature"),
        F.when(i % 3 == 0, F.concat(F.lit("NR(A0201_"), "cdr3a", F.lit(")_x"))).otherwise(F.concat(F.lit("B0702_"), "cdr3b", F.lit("_y"))).alias("gene_id"),
        F.when(i % 5 == 0, genes.EXPRESSION).otherwise(genes.ANTIBODY).alias("feature_type"),
    )
    return genes.complex_names(f)


@query(f"WITH {R}, c AS (SELECT split_part(va, '*', 1) AS label, count(*) AS n FROM r GROUP BY 1), o AS (SELECT label, row_number() OVER (ORDER BY n DESC, label DESC) AS rank FROM c) SELECT label, rank, ['red', 'green', 'blue', 'gray'][least(rank, 4)] AS color FROM o")
def gene_colors(spark, sf_dir):
    c = adapters.receptors(spark, sf_dir).groupBy(scores.trim_allele(F.col("va")).alias("label")).agg(F.count("*").alias("n"))
    return genes.label_colors(c, ["red", "green", "blue", "gray"]).withColumn("rank", F.col("rank").cast("long"))


# ---- receptor scores ---------------------------------------------------------------------------
_V_ORDER, _J_ORDER = [f"TRAV{k}" for k in range(1, 20)], [f"TRAJ{k}" for k in range(12, 2, -1)]
_HYDRO = "map {'A': 1.8, 'C': 2.5, 'D': -3.5, 'E': -3.5, 'F': 2.8, 'G': -0.4, 'H': -3.2, 'I': 4.5, 'K': -3.9, 'L': 3.8, 'M': 1.9, 'N': -3.5, 'P': -1.6, 'Q': -3.5, 'R': -4.5, 'S': -0.8, 'T': -0.7, 'V': 4.2, 'W': -0.9, 'Y': -1.3}"
_PROPERTIES = {"hydropathy": scores.HYDROPATHY, "charge": scores.CHARGE}
#: A model for the queries: (feature, mean, var, coef, intercept).
_LINEAR = [("len_AB", 9.0, 4.0, 0.7, -0.3), ("Gfrac_A", 0.1, 0.04, -0.4, -0.3), ("arofrac_B", 0.2, 0.09, 0.9, -0.3), ("hydropathy_AB", 0.5, 2.25, 0.25, -0.3), ("charge_B", 0.0, 1.0, 0.0, -0.3)]
_WINDOW = 3


def _logistic(chain: str) -> dict:
    vs, js = [f"TR{chain}V{k}" for k in range(1, 16)], [f"TR{chain}J{k}" for k in range(1, 9)]
    size = len(vs) + 1 + len(js) + 1 + (14 - 9 + 1) + 20 * (2 * _WINDOW + 1) + 1
    return {"v_genes": vs, "j_genes": js, "min_len": 9, "max_len": 14, "window": _WINDOW, "weights": [((k * 37) % 101 - 50) / 50 for k in range(size)]}


def _letters_sql(name: str, start: str, size: str, c: str) -> str:
    return f"{name} AS (SELECT id, substring(cdr3{c}, {start}, greatest({size}, 0)) AS s FROM inv)"


def _property_sql(c: str, mode: str) -> str:
    part = f"substring(cdr3{c}, 5, greatest(length(cdr3{c}) - 8, 0))" if mode == "fg" else f"CASE WHEN length(cdr3{c}) - 1 >= 5 THEN substring(cdr3{c}, 2 + (length(cdr3{c}) - 6) // 2, 5) ELSE '' END"
    return f"CASE WHEN length({part}) > 0 THEN list_sum(list_transform(string_split({part}, ''), lambda a: {_HYDRO}[a]))::DOUBLE / length({part}) ELSE -0.49 END"


@query(f"WITH {R}, {INV} SELECT id, length(cdr3a) + 2 * length(cdr3b) AS cdr3len, round({_property_sql('a', 'fg')} + {_property_sql('b', 'fg')}, 6) AS hydro_fg, round({_property_sql('a', 'cen')} + {_property_sql('b', 'cen')}, 6) AS hydro_cen FROM inv")
def cdr3_properties(spark, sf_dir):
    r = _invariant(spark, sf_dir)
    col = lambda n: scores.score_column(n, _PROPERTIES)
    return r.select("id", col("cdr3len").cast("long").alias("cdr3len"), F.round(col("hydropathy_fg"), 6).alias("hydro_fg"), F.round(col("hydropathy_cen"), 6).alias("hydro_cen"))


_PLACE = "CASE WHEN p IS NULL THEN {half} ELSE {known} END"


@query(f"""WITH {R}, {INV}, l AS (SELECT id, nullif(list_position([{', '.join(map(repr, _V_ORDER))}], split_part(va, '*', 1)), 0) AS v, nullif(list_position([{', '.join(map(repr, _J_ORDER))}], split_part(ja, '*', 1)), 0) AS j FROM inv)
 SELECT id, CAST(CASE WHEN v IS NULL THEN 9.0 ELSE 18 - (v - 1) END + CASE WHEN j IS NULL THEN 4.5 ELSE j - 1 END AS DOUBLE) AS alphadist FROM l""")
def locus_distances(spark, sf_dir):
    return _invariant(spark, sf_dir).select("id", scores.locus_distance(F.col("va"), F.col("ja"), _V_ORDER, _J_ORDER).alias("alphadist"))


def _linear_sql() -> str:
    la, lb = ("substring(cdr3{0}, 5, greatest(length(cdr3{0}) - 8, 0))".format(c) for c in "ab")
    mean = lambda s: f"CASE WHEN length({s}) > 0 THEN list_sum(list_transform(string_split({s}, ''), lambda a: {_HYDRO}[a]))::DOUBLE / length({s}) ELSE 0 END"
    g = f"(length({la}) - length(replace({la}, 'G', '')))::DOUBLE / greatest(1, length({la}))"
    aro = f"length(regexp_replace({lb}, '[^FYWH]', '', 'g'))::DOUBLE / greatest(1, length({lb}))"
    return f"-0.3 + 0.7 * ((length({la}) + length({lb})) - 9.0) / 2.0 - 0.4 * ({g} - 0.1) / 0.2 + 0.9 * ({aro} - 0.2) / 0.3 + 0.25 * (({mean(la)}) + ({mean(lb)}) - 0.5) / 1.5"


@query(f"WITH {R}, {INV} SELECT id, round(CAST({_linear_sql()} AS DOUBLE), 6) AS imhc FROM inv")
def linear_model_score(spark, sf_dir):
    rows = [dict(zip(("feature", "mean", "var", "coef", "intercept"), r, strict=True)) for r in _LINEAR]
    return _invariant(spark, sf_dir).select("id", F.round(scores.linear_model(F.col("cdr3a"), F.col("cdr3b"), rows, _PROPERTIES), 6).alias("imhc"))


def _logistic_sql(c: str) -> str:
    m = _logistic(c.upper())
    nv, nj, nl, w = len(m["v_genes"]) + 1, len(m["j_genes"]) + 1, 6, _WINDOW
    base = nv + nj + nl
    weight = lambda k: f"((({k}) * 37) % 101 - 50) / 50.0"
    place = lambda ch: f"(instr('ACDEFGHIKLMNPQRSTVWY', {ch}) - 1)"
    gene = lambda g, names: f"coalesce(nullif(list_position([{', '.join(map(repr, names))}], split_part({g}, '*', 1)), 0) - 1, {len(names)})"
    s, n = f"cdr3{c}", f"length(cdr3{c})"
    head = f"least({w}, {n} // 2)"
    terms = [weight(gene(f"v{c}", m["v_genes"])), weight(f"{nv} + {gene(f'j{c}', m['j_genes'])}"), weight(f"{nv + nj} + least(greatest({n}, 9), 14) - 9")]
    terms += [f"(CASE WHEN {i} < {head} THEN {weight(f'{base + 20 * i} + ' + place(f'{s}[{i + 1}]'))} ELSE 0 END)" for i in range(w)]
    terms += [f"(CASE WHEN {i} < least({w}, {n} - {head}) THEN {weight(f'{base + 20 * w + 20 * i} + ' + place(f'{s}[{n} - {i}]'))} ELSE 0 END)" for i in range(w)]
    middle = f"{s}[{head} + 1 : {n} - least({w}, {n} - {head})]"
    terms += [f"coalesce(list_sum(list_transform(list_filter(string_split({middle}, ''), lambda a: a <> ''), lambda a: {weight(f'{base + 40 * w} + ' + place('a'))})), 0)", str(m["weights"][-1])]
    return " + ".join(terms)


@query(f"WITH {R}, {INV} SELECT id, round(CAST(0.5 * (({_logistic_sql('a')}) + ({_logistic_sql('b')})) AS DOUBLE), 6) AS cd8 FROM inv")
def logistic_model_score(spark, sf_dir):
    c = F.col
    a, b = (scores.logistic_chain(c(f"v{x}"), c(f"j{x}"), c(f"cdr3{x}"), _logistic(x.upper())) for x in "ab")
    return _invariant(spark, sf_dir).select("id", F.round(scores.logistic_score(a, b), 6).alias("cd8"))


def _strong_sql(c: str) -> str:
    s = f"substring(cdr3{c}, 5, greatest(length(cdr3{c}) - 8, 0))"
    k = lambda a: f"(length({s}) - length(replace({s}, '{a}', '')))"
    return f"CASE WHEN length(cdr3{c}) <= 8 THEN 0 ELSE length({s}) + 3.0 * {k('C')} + 2.0 * {k('W')} + {k('R')} + {k('K')} + 0.5 * {k('H')} - {k('D')} - {k('E')} END"


_NAMES = ["cdr3len", "tcr_cluster2", "old_imhc", "mait", "inkt", "nndists_tcr", "TRAV3", "TRBV8*01", "G_frac", "hydropathy"]


@query(f"""WITH {R}, {INV}, w AS (SELECT id, CAST(length(cdr3a) + 2 * length(cdr3b) AS DOUBLE) AS cdr3len, CAST(ct = 2 AS INT)::DOUBLE AS tcr_cluster2, CAST({_strong_sql('a')} + 2 * ({_strong_sql('b')}) AS DOUBLE) AS old_imhc, CAST({_MAIT} AS INT)::DOUBLE AS mait, CAST({_INKT} AS INT)::DOUBLE AS inkt, 0.0::DOUBLE AS nndists_tcr,
 CAST(split_part(va, '*', 1) = 'TRAV3' AS INT)::DOUBLE AS "TRAV3", CAST(vb = 'TRBV8*01' AS INT)::DOUBLE AS "TRBV8*01", {' + '.join(f"CASE WHEN length(cdr3{c}) > 8 THEN (length(cdr3{c}[5:length(cdr3{c})-4]) - length(replace(cdr3{c}[5:length(cdr3{c})-4], 'G', '')))::DOUBLE / (length(cdr3{c}) - 8) ELSE 0.05 END" for c in 'ab')} AS "G_frac",
 {_property_sql('a', 'fg')} + {_property_sql('b', 'fg')} AS hydropathy FROM inv) SELECT id, feature, round(value, 6) AS value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE id) INTO NAME feature VALUE value)""")
def score_table(spark, sf_dir):
    wide = _invariant(spark, sf_dir).select("id", *(scores.score_column(n, _PROPERTIES).alias(n) for n in _NAMES))
    return wide.unpivot("id", [f"`{n}`" for n in _NAMES], "feature", "value").withColumn("value", F.round("value", 6))


_ENRICH = {"genes": {"TRAV1": 0.3, "TRAJ2": -0.2, "TRBV5": 0.1}, "lengths": {k: (k - 12) / 20 for k in range(10, 15)}, "letters": {a: (k - 10) / 50 for k, a in enumerate("ACDEFGHIKLMNPQRSTVWY")}}


@query(f"""WITH {R}, {INV}, t AS (SELECT id, CASE split_part(va, '*', 1) WHEN 'TRAV1' THEN 0.3 WHEN 'TRBV5' THEN 0.1 ELSE 0 END + CASE split_part(ja, '*', 1) WHEN 'TRAJ2' THEN -0.2 ELSE 0 END + (least(greatest(length(cdr3a), 10), 14) - 12) / 20.0
 + coalesce(list_sum(list_transform(list_filter(string_split(substring(cdr3a, 5, greatest(length(cdr3a) - 8, 0)), ''), lambda a: a <> ''), lambda a: (instr('ACDEFGHIKLMNPQRSTVWY', a) - 11) / 50.0)), 0) AS s FROM inv) SELECT id, round(CAST(s AS DOUBLE), 6) AS score FROM t""")
def lookup_score(spark, sf_dir):
    return _invariant(spark, sf_dir).select("id", F.round(scores.lookup_score(F.col("va"), F.col("ja"), F.col("cdr3a"), **_ENRICH), 6).alias("score"))


_CODON = "['F','F','L','L','S','S','S','S','Y','Y','*','*','C','C','*','W','L','L','L','L','P','P','P','P','H','H','Q','Q','R','R','R','R','I','I','I','M','T','T','T','T','N','N','K','K','S','S','R','R','V','V','V','V','A','A','A','A','D','D','E','E','G','G','G','G']"
_SEQ = "concat(translate(md5(concat('n', id)), '0123456789abcdef', 'acgtacgtacgtacgt'), cast(id % 10 as varchar))"


@query(f"""WITH {R}, s AS (SELECT id, translate(md5(concat('n', id)), '0123456789abcdef', 'acgtacgtacgtacgt') AS s FROM r), k AS (SELECT id, s, unnest(range(0, 10)) AS k FROM s),
 c AS (SELECT id, k, {_CODON}[1 + 16 * (instr('tcag', s[3 * k + 2]) - 1) + 4 * (instr('tcag', s[3 * k + 3]) - 1) + instr('tcag', s[3 * k + 4]) - 1] AS a FROM k) SELECT id, string_agg(a, '' ORDER BY k) AS protein FROM c GROUP BY id""")
def translation(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir).select("id", F.expr("translate(md5(concat('n', id)), '0123456789abcdef', 'acgtacgtacgtacgt')").alias("s"))
    return r.select("id", scores.translate(F.col("s"), 2).alias("protein"))


# ---- sequences of receptors --------------------------------------------------------------------
@query(f"WITH {R} SELECT id, letter, count(*) AS n FROM (SELECT id, unnest(string_split(cdr3b, '')) AS letter FROM r) GROUP BY ALL")
def letter_counts(spark, sf_dir):
    return sequences.letter_counts(adapters.receptors(spark, sf_dir).select("id", F.col("cdr3b").alias("seq")))


@query(f"""WITH {R}, n AS (SELECT length(cdr3b) AS len, unnest(range(0, length(cdr3b))) AS pos, unnest(string_split(cdr3b, '')) AS letter FROM r), c AS (SELECT CAST(len AS INT) AS len, CAST(pos AS INT) AS pos, letter, count(*) AS n FROM n GROUP BY ALL), a AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS letter),
 g AS (SELECT len, pos, sum(n) AS tot FROM c GROUP BY ALL) SELECT g.len, g.pos, a.letter, round((coalesce(n, 0) + 0.5) / (tot + 10.0), 9) AS freq FROM g CROSS JOIN a LEFT JOIN c ON c.len = g.len AND c.pos = g.pos AND c.letter = a.letter""")
def pwm(spark, sf_dir):
    done = sequences.pwm_with_pseudocounts(adapters.receptors(spark, sf_dir).select(F.col("cdr3b").alias("seq")), 0.5)
    return done.withColumn("freq", F.round("freq", 9))


@query(f"""WITH {R}, w AS (SELECT 'B' || substring(cdr3b, 4, length(cdr3b) - 5) || 'Z' AS s FROM r), k AS (SELECT s, unnest(range(1, length(s) + 1)) AS k FROM w),
 g AS (SELECT s, k, x, y FROM k, (SELECT unnest([1, 2, 3]) AS x), (SELECT unnest([1, 2, 3]) AS y) WHERE k + x + y <= length(s))
 SELECT s[k] || repeat('.', x - 1) || s[k + x] || repeat('.', y - 1) || s[k + x + y] AS core, count(*) AS n FROM g GROUP BY 1""")
def motif_core_counts(spark, sf_dir):
    return sequences.motif_cores(adapters.receptors(spark, sf_dir).select("id", F.col("cdr3b").alias("seq")))


@query(f"""WITH {R}, {DB}, g AS (SELECT cdr3a, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS barcodes, array_to_string(list_sort(list_distinct(list(CAST(cg AS VARCHAR)))), ',') AS clusters_gex, array_to_string(list_sort(list_distinct(list(CAST(ct AS VARCHAR)))), ',') AS clusters_tcr FROM r GROUP BY 1)
 SELECT q.id, q.cdr3a, barcodes, clusters_gex, clusters_tcr FROM q JOIN g USING (cdr3a)""")
def strict_match(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir).withColumnRenamed("id", "barcode")
    return clones.strict_matches(adapters.receptor_database(spark, sf_dir).select("id", "cdr3a"), r, "cdr3a")


_MHC = "CASE id % 5 WHEN 0 THEN 'HLA-A*02:01' WHEN 1 THEN 'HLA-DRB1*04' WHEN 2 THEN 'H2-Kb' WHEN 3 THEN 'unknown' END"
_CLASS = "CASE WHEN regexp_matches(upper(coalesce(mhc, '')), '(^|HLA-)(A|B|C|E)[0-9]*|^H-?2-?[KDL]') THEN 'I' WHEN regexp_matches(upper(coalesce(mhc, '')), '(^|HLA-)D[RPQ]|^H-?2-?I') THEN 'II' END"


@query(f"""WITH {R}, {DB}, b AS (SELECT id, cdr3a, cdr3b, {_MHC} AS mhc FROM q), n AS (SELECT id, cdr3a, cdr3b, {_MHC} AS mhc, row_number() OVER (PARTITION BY cdr3a, cdr3b ORDER BY id) AS k FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.cdr3a = r.cdr3a AND b.cdr3b = r.cdr3b))
 SELECT id, cdr3a, cdr3b, mhc, {_CLASS} AS mhc_class FROM (SELECT * FROM b UNION ALL SELECT id, cdr3a, cdr3b, mhc FROM n WHERE k = 1)""")
def anti_merge(spark, sf_dir):
    row = lambda df: df.select("id", "cdr3a", "cdr3b", F.expr(_MHC).alias("mhc"))
    return clones.merged_database(row(adapters.receptor_database(spark, sf_dir)), row(adapters.receptors(spark, sf_dir)))


# ---- clones ------------------------------------------------------------------------------------
PARTS = """parts AS (SELECT o_custkey AS clone, CAST(l_orderkey AS VARCHAR) AS barcode, CASE WHEN l_linenumber % 2 = 1 THEN 'A' ELSE 'B' END AS ab, p_brand AS v_gene, p_type AS j_gene, replace(p_name, ' ', '') AS cdr3, lower(p_name) AS cdr3_nt, CAST(l_quantity AS BIGINT) AS umis, l_linestatus = 'O' AS productive
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _parts(spark, sf_dir) -> DataFrame:
    li, o, p = (adapters.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    odd = F.col("l_linenumber") % 2 == 1
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("o_custkey").alias("clone"), F.col("l_orderkey").cast("string").alias("barcode"), F.when(odd, "TRA").otherwise("TRB").alias("chain"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"),
        F.replace("p_name", F.lit(" "), F.lit("")).alias("cdr3"), F.col("p_name").alias("cdr3_nt"), F.col("l_quantity").cast("long").alias("umis"), (F.col("l_linestatus") == "O").alias("productive"),
    )


@query(f"""WITH {PARTS}, u AS (SELECT clone, ab, v_gene, j_gene, cdr3, cdr3_nt, CAST(sum(umis) AS BIGINT) AS umis FROM parts WHERE productive GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY clone, ab ORDER BY umis DESC, v_gene, j_gene, cdr3, cdr3_nt) AS k FROM u),
 z AS (SELECT clone, count(DISTINCT barcode) AS clone_size FROM parts GROUP BY 1),
 t AS (SELECT clone, {', '.join(f"coalesce(max({c}) FILTER (ab = '{ab}' AND k = {k}), {d}) AS {n}" for ab, k, tag, u in (('A', 1, 'a', 'alpha_umi'), ('A', 2, 'a2', 'alpha2_umi'), ('B', 1, 'b', 'beta_umi')) for c, n, d in (('v_gene', f'v{tag}_gene', "''"), ('j_gene', f'j{tag}_gene', "''"), ('cdr3', f'cdr3{tag}', "''"), ('cdr3_nt', f'cdr3{tag}_nucseq', "''"), ('umis', u, '0')))},
 count(*) FILTER (ab = 'A') AS num_alphas, count(*) FILTER (ab = 'B') AS num_betas FROM o GROUP BY clone) SELECT t.* EXCLUDE clone, clone AS clone_id, 'UNK_S' AS subject, clone_size FROM t JOIN z USING (clone) WHERE num_alphas > 0 AND num_betas > 0 AND length(cdr3a) >= 6 AND length(cdr3b) >= 6""")
def clone_rows(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return clones.clone_rows(clones.chain_counts(clones.clean_contigs(p)), clones.clone_barcodes(p))


@query()
def stringent_clones(spark, sf_dir):
    p = _parts(spark, sf_dir)
    counts = clones.chain_counts(clones.clean_contigs(p)).select("clone", "ab", F.concat_ws("|", *clones.PARTS).alias("chain"), "umis")
    named, cells_ = clones.stringent_clones(counts, clones.clone_barcodes(p))
    return named.join(cells_, "clone")


@query(f"WITH {R}, e AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey AS barcode, r.id AS clone_id, va, cdr3b, vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM orders JOIN r ON r.id = o_custkey JOIN embeddings ON vec_id = r.id")
def joined_dataset(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    r = adapters.receptors(spark, sf_dir)
    table = r.select(F.col("id").alias("clone_id"), F.col("va").alias("va_gene"), F.col("ja").alias("ja_gene"), "cdr3a", F.lower("cdr3a").alias("cdr3a_nucseq"), F.col("vb").alias("vb_gene"), F.col("jb").alias("jb_gene"), "cdr3b", F.lower("cdr3b").alias("cdr3b_nucseq"))
    bars = o.groupBy(F.col("o_custkey").alias("clone_id")).agg(F.collect_list("o_orderkey").alias("barcodes"))
    kpc = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clone_id"), F.col("embedding").cast("array<double>").alias("kpc"))
    done = clones.joined_dataset(o.select(F.col("o_orderkey").alias("barcode")), table, bars, kpc)
    return done.select("barcode", "clone_id", F.col("va_gene").alias("va"), "cdr3b", F.col("clone_id").alias("vec_id"), F.round(F.col("kpc")[0], 6).alias("first"))


@query("""WITH a AS (SELECT o_custkey AS clone, o_orderkey AS barcode FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey % 7 AS clone, o_orderkey AS barcode FROM orders WHERE o_orderkey % 4 = 0)
 SELECT o_orderkey AS barcode, a.clone AS clone_1, b.clone AS clone_2 FROM orders LEFT JOIN a ON a.barcode = o_orderkey LEFT JOIN b ON b.barcode = o_orderkey WHERE a.clone IS NULL OR b.clone IS NULL""")
def two_repertoires(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders")
    lists = lambda rows, c: rows.groupBy(c.alias("clone")).agg(F.collect_list("o_orderkey").alias("barcodes"))
    a, b = lists(o.where("o_orderkey % 3 <> 0"), F.col("o_custkey")), lists(o.where("o_orderkey % 4 = 0"), F.col("o_custkey") % 7)
    return clones.two_repertoires(o.select(F.col("o_orderkey").alias("barcode")), a, b)


@query(f"WITH {R} SELECT id, va, ja, cdr3a, lower(cdr3a) || '_S' || (id % 3) AS nta, vb, jb, cdr3b, lower(cdr3b) || '_S' || (id % 3) AS ntb FROM r")
def receptor_pack(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir).select("id", *(F.col(f"{k}{c}").alias(f"{k}{c}_gene") for c in "ab" for k in "vj"), *(e for c in "ab" for e in (F.col(f"cdr3{c}"), F.col(f"cdr3{c}").alias(f"cdr3{c}_nucseq"))), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("subject"))
    back = clones.unpacked_receptors(clones.packed_receptors(r, "subject").select("id", "tcr"))
    return back.select("id", F.col("va_gene").alias("va"), F.col("ja_gene").alias("ja"), "cdr3a", F.col("cdr3a_nucseq").alias("nta"), F.col("vb_gene").alias("vb"), F.col("jb_gene").alias("jb"), "cdr3b", F.col("cdr3b_nucseq").alias("ntb"))


# ---- cells and clusters ------------------------------------------------------------------------
_AB = "ab AS (SELECT l_orderkey AS cell, l_suppkey AS feature, ln(1 + sum(l_quantity)) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 3 = 0 GROUP BY ALL)"


@query(f"WITH {_AB}, n AS (SELECT count(*) AS n FROM supplier WHERE s_nationkey % 3 = 0) SELECT cell, feature, round(x - sum(x) OVER (PARTITION BY cell) / n, 6) AS x FROM ab, n")
def antibody_clr(spark, sf_dir):
    kinds = adapters.table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_suppkey").alias("feature"))
    counts = adapters.cell_gene(spark, sf_dir).join(kinds, "feature", "left_semi")
    return aggregates.antibody_clr(counts, kinds.count()).withColumn("x", F.round("x", 6))


_MOMENT = f"{CELLS}, {ONE}, nn AS (SELECT CAST(count(DISTINCT cell) AS DOUBLE) AS n FROM counts), s AS (SELECT feature, sum(exp(x) - 1) AS s, sum((exp(x) - 1) * (exp(x) - 1)) AS ss FROM x GROUP BY 1), mo AS (SELECT feature, ln(1 + s / n) AS mean, ln((ss - n * (s / n) * (s / n)) / (n - 1) / (s / n)) AS d FROM s, nn)"


@query(f"""WITH {_MOMENT}, lim AS (SELECT min(mean) AS lo, max(mean) AS hi FROM mo), b AS (SELECT mo.*, least(greatest(CAST(ceil((mean - lo) / ((hi - lo) / 20)) AS BIGINT), 1), 20) AS bin FROM mo, lim), st AS (SELECT bin, avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM b GROUP BY 1)
 SELECT feature, round(CASE WHEN n = 1 THEN 1.0 ELSE (d - m) / sd END, 5) AS normalised, mean > 0.0125 AND mean < 9 AND CASE WHEN n = 1 THEN 1.0 ELSE (d - m) / sd END > 0.5 AS variable FROM b JOIN st USING (bin)""")
def variable_features(spark, sf_dir):
    counts = aggregates.check_raw_counts(adapters.cell_gene(spark, sf_dir), 1.0)
    m = cells.dispersion(cells.normalize_log1p(counts), counts.select("cell").distinct().count())
    return aggregates.variable_features(m, max_mean=9.0).select("feature", F.round("normalised", 5).alias("normalised"), "variable")


_GENE_ROWS = "vals AS (SELECT id, 'g' || unnest(range(1, 33)) AS feature, unnest(list_transform(gex, lambda v: greatest(v, 0.0))) AS value FROM nodes)"


def _gene_rows(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir)
    return n, n.select("id", F.posexplode(F.transform("gex", lambda v: F.greatest(v, F.lit(0.0)))).alias("p", "value")).select("id", F.concat(F.lit("g"), (F.col("p") + 1).cast("string")).alias("feature"), "value")


@query(f"""WITH {NODES}, {_GENE_ROWS}, cv AS (SELECT id, tcr[1] AS u, tcr[2] AS v FROM nodes), m AS (SELECT avg(u) AS mu, avg(v) AS mv, var_pop(u) AS vu, var_pop(v) AS vv, covar_pop(u, v) AS c FROM cv),
 f AS (SELECT feature, avg(value) AS my, covar_pop(u, value) AS cu, covar_pop(v, value) AS cv FROM vals JOIN cv USING (id) GROUP BY 1), b AS (SELECT feature, my, (cu * vv - cv * c) / (vu * vv - c * c) AS bu, (cv * vu - cu * c) / (vu * vv - c * c) AS bv, mu, mv FROM f, m),
 e AS (SELECT vals.id, feature, value - my - bu * (u - mu) - bv * (v - mv) AS e FROM vals JOIN cv USING (id) JOIN b USING (feature)) SELECT id, feature, round(greatest(-10, least(10, e / stddev_samp(e) OVER (PARTITION BY feature))), 5) AS z FROM e""")
def regress_out(spark, sf_dir):
    n, v = _gene_rows(spark, sf_dir)
    return aggregates.regressed(v, n.select("id", F.col("tcr")[0].alias("u"), F.col("tcr")[1].alias("v"))).withColumn("z", F.round("z", 5))


@query("SELECT o_custkey AS clone, 'priority' AS key, o_orderpriority AS choice, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT o_custkey, 'status', o_orderstatus, count(*) FROM orders GROUP BY ALL")
def clone_batches(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clone"), F.explode(F.array(F.struct(F.lit("priority").alias("key"), F.col("o_orderpriority").alias("choice")), F.struct(F.lit("status").alias("key"), F.col("o_orderstatus").alias("choice")))).alias("b"))
    return aggregates.clone_batches(o.select("clone", "b.*"))


@query(f"WITH {CELLS}, {ONE}, c AS (SELECT o_custkey AS clone, o_orderkey AS cell FROM orders), n AS (SELECT clone, count(*) AS n FROM c GROUP BY 1) SELECT clone, feature, round(sum(x) / any_value(n.n), 6) AS mean FROM c JOIN x USING (cell) JOIN n USING (clone) GROUP BY clone, feature")
def clone_means(spark, sf_dir):
    o = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clone"), F.col("o_orderkey").alias("cell"))
    return aggregates.clone_means(o, cells.normalize_log1p(adapters.cell_gene(spark, sf_dir))).withColumn("mean", F.round("mean", 6))


_SETS = {"one": ["g1", "g2", "g3"], "two": ["g4", "none"], "g5": ["g5"]}


@query(f"""WITH {NODES}, {_GENE_ROWS}, s AS (SELECT * FROM (VALUES ('one','g1'),('one','g2'),('one','g3'),('two','g4'),('two','none'),('g5','g5')) t("set", feature)), m AS (SELECT cg AS cluster, "set", feature, avg(value) AS m FROM vals JOIN s USING (feature) JOIN nodes USING (id) GROUP BY ALL)
 SELECT cluster, "set", round(avg(m), 6) AS score FROM m GROUP BY ALL""")
def cluster_gene_scores(spark, sf_dir):
    n, v = _gene_rows(spark, sf_dir)
    return aggregates.cluster_gene_scores(v, n, "cg", _SETS).withColumn("score", F.round("score", 6))


@query(f"""WITH {NODES}, {_GENE_ROWS}, z AS (SELECT id, feature, greatest(-10, least(10, (value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature))) AS z FROM vals WHERE feature IN ('g1', 'g2', 'g9')), m AS (SELECT feature, avg(z) AS m FROM z JOIN nodes USING (id) WHERE ct = 3 GROUP BY 1)
 SELECT round(avg(m), 6) AS score FROM m""")
def gene_score(spark, sf_dir):
    n, v = _gene_rows(spark, sf_dir)
    return aggregates.gene_score(v, n.where("ct = 3"), ["g1", "g2", "g9", "absent"], True).withColumn("score", F.round("score", 6))


@query(f"WITH {NODES} SELECT cg, ct, count(*) AS n FROM nodes WHERE tcr[1] > 0 GROUP BY ALL HAVING count(*) >= 5")
def biclusters(spark, sf_dir):
    return aggregates.biclusters(adapters.nodes(spark, sf_dir), F.col("tcr")[0] > 0)


@query(f"""WITH {R}, s AS (SELECT unnest([cg, -1]) AS cluster, va, ja, vb, jb FROM r), l AS (SELECT cluster, 'va' AS slot, split_part(va, '*', 1) AS gene FROM s UNION ALL SELECT cluster, 'ja', split_part(ja, '*', 1) FROM s UNION ALL SELECT cluster, 'vb', split_part(vb, '*', 1) FROM s UNION ALL SELECT cluster, 'jb', split_part(jb, '*', 1) FROM s)
, n AS (SELECT cluster, slot, gene, count(*) AS n FROM l GROUP BY ALL) SELECT cluster, slot, gene, n, round(n / sum(n) OVER (PARTITION BY cluster, slot), 9) AS fraction FROM n""")
def cluster_composition(spark, sf_dir):
    return aggregates.cluster_composition(adapters.receptors(spark, sf_dir), "cg").withColumn("fraction", F.round("fraction", 9))


@query(f"WITH {R} SELECT gene, count(*) AS n FROM (SELECT split_part(unnest([va, ja, vb, jb]), '*', 1) AS gene FROM r) GROUP BY 1 HAVING count(*) >= 5")
def frequent_genes(spark, sf_dir):
    return aggregates.frequent_genes(adapters.receptors(spark, sf_dir))


@query(f"""WITH {NODES}, {_GENE_ROWS}, s AS (SELECT cg AS "group", feature, avg(CAST(value > 0 AS INT)) AS fraction, avg(value) AS mean FROM vals JOIN nodes USING (id) GROUP BY ALL) SELECT "group", feature, round(fraction, 6) AS fraction, round(mean, 6) AS mean, round(CASE WHEN max(mean) OVER (PARTITION BY feature) > 0 THEN mean / max(mean) OVER (PARTITION BY feature) ELSE 0 END, 6) AS scaled FROM s""")
def logo_stats(spark, sf_dir):
    n, v = _gene_rows(spark, sf_dir)
    return aggregates.logo_stats(v, n.select("id", F.col("cg").alias("group"))).select("group", "feature", *(F.round(c, 6).alias(c) for c in ("fraction", "mean", "scaled")))


@query("""WITH m AS (SELECT o_custkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 50 AS d, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'E' || o_orderkey % 6 END AS epitope, CASE WHEN o_orderkey % 3 = 0 THEN 'G' || o_orderkey % 5 END AS gene, CASE WHEN o_orderkey % 2 = 0 THEN 'A' || o_orderkey % 3 END AS mhc FROM orders),
 l AS (SELECT id, d, coalesce(nullif(epitope, ''), nullif(gene, ''), 'UNKNOWN') AS e, coalesce(nullif(mhc, ''), 'UNKNOWN') AS h FROM m), b AS (SELECT *, h || '-' || e AS label, row_number() OVER (PARTITION BY id ORDER BY d, h || '-' || e) AS r FROM l)
 SELECT label, count(DISTINCT id) AS n_clones, round(CAST(count(DISTINCT id) - 0.1 * max(CAST(e = 'UNKNOWN' AS INT) + CAST(h = 'UNKNOWN' AS INT)) AS DOUBLE), 6) AS weight FROM b WHERE r = 1 GROUP BY label""")
def literature_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    m = adapters.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), (F.floor("o_totalprice") % 50).alias("d"), F.when(k % 4 == 0, "").when(k % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit("E"), (k % 6).cast("string"))).alias("epitope"),
        F.when(k % 3 == 0, F.concat(F.lit("G"), (k % 5).cast("string"))).alias("gene"), F.when(k % 2 == 0, F.concat(F.lit("A"), (k % 3).cast("string"))).alias("mhc"),
    )
    return aggregates.literature_labels(m).withColumn("weight", F.round("weight", 6))


@query("SELECT id, size FROM (SELECT o_custkey AS id, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, o_custkey DESC) AS r FROM orders GROUP BY 1 HAVING count(*) >= 5) WHERE r <= 75")
def largest_clones(spark, sf_dir):
    return aggregates.largest_clones(adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("size")))


@query(f"WITH {CELLS}, {ONE}, e AS (SELECT cell, feature, exp(x) - 1 AS e FROM x WHERE x > 0) SELECT cell, feature, round(e / min(e) OVER (PARTITION BY cell), 5) AS n FROM e")
def unlogged_counts(spark, sf_dir):
    return aggregates.unlogged(cells.normalize_log1p(adapters.cell_gene(spark, sf_dir))).withColumn("n", F.round("n", 5))


@query(f"WITH {NODES}, m AS (SELECT cg, avg(gex[1]) AS mx, avg(gex[2]) AS my, sqrt(var_pop(gex[1]) + var_pop(gex[2])) AS sd FROM nodes GROUP BY 1) SELECT cg, CAST(k AS INT) AS k, round(mx + 0.25 * sd * sin(2 * pi() * k / 5), 6) AS x, round(my + 0.25 * sd * cos(2 * pi() * k / 5), 6) AS y FROM m, (SELECT unnest(range(0, 5)) AS k)")
def ring_points(spark, sf_dir):
    p = adapters.nodes(spark, sf_dir).select("cg", F.col("gex")[0].alias("x"), F.col("gex")[1].alias("y"))
    return aggregates.ring_points(p, "cg", 5).select("cg", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {R}, s AS (SELECT ct, row_number() OVER (ORDER BY id) AS k FROM r), d AS (SELECT id, row_number() OVER (ORDER BY md5('1-' || id), id) AS k FROM r) SELECT d.id, s.ct FROM d JOIN s USING (k)")
def shuffled_clusters(spark, sf_dir):
    return aggregates.permuted(adapters.receptors(spark, sf_dir).select("id", "ct"), "ct", 1)


_MARK = "mk AS (SELECT id, cg, gex[1] AS c4, gex[2] AS c8a, gex[3] AS c8b, greatest(0, gex[4]) AS n4, greatest(0, gex[5]) AS n8a, greatest(0, gex[6]) AS n8b, bg AS clone FROM nodes), cl AS (SELECT cg, avg(c4) / 0.6 AS m4, avg((c8a + c8b) / 2) / 2.0 AS m8 FROM mk GROUP BY 1)"


def _markers(spark, sf_dir):
    g = lambda k: F.col("gex")[k]
    return adapters.nodes(spark, sf_dir).select("id", "cg", g(0).alias("c4"), g(1).alias("c8a"), g(2).alias("c8b"), *(F.greatest(F.lit(0.0), g(k)).alias(n) for k, n in ((3, "n4"), (4, "n8a"), (5, "n8b"))), F.col("bg").alias("clone"), F.col("id").alias("cell"))


@query(f"WITH {NODES}, {_MARK} SELECT id FROM mk JOIN cl USING (cg) WHERE m4 > m8")
def marker_subset(spark, sf_dir):
    return subsets.marker_subset(_markers(spark, sf_dir), "cg", "CD4", ["c4"], ["c8a", "c8b"]).select("id")


_TAG = f"{_MARK}, tg AS (SELECT id, clone, CASE WHEN n4 > 0.5 AND n8a + n8b < 0.5 THEN 'cd4' WHEN n8a + n8b > 1.5 AND n4 < 0.5 THEN 'cd8' WHEN m4 > m8 THEN 'cd4' ELSE 'cd8' END AS tag FROM mk JOIN cl USING (cg))"


@query(f"WITH {NODES}, {_TAG} SELECT id, tag, CASE WHEN sum(CAST(tag = 'cd4' AS INT)) OVER (PARTITION BY clone) > sum(CAST(tag = 'cd8' AS INT)) OVER (PARTITION BY clone) THEN 'cd4' WHEN sum(CAST(tag = 'cd8' AS INT)) OVER (PARTITION BY clone) > sum(CAST(tag = 'cd4' AS INT)) OVER (PARTITION BY clone) THEN 'cd8' ELSE tag END AS subset FROM tg")
def marker_votes(spark, sf_dir):
    tagged = subsets.marker_tags(_markers(spark, sf_dir), "cg", "c4", ("c8a", "c8b"), ("n4", "n8a", "n8b"))
    return subsets.clone_vote(tagged).select("id", F.col("cd4_or_cd8").alias("tag"), "subset")


@query()
def marker_split(spark, sf_dir):
    def assign(rows):
        side = (F.col("c4") > F.col("c8a")).cast("int")
        return subsets.marker_tags(rows.withColumn("k", F.col("cg") * 2 + side), "k", "c4", ("c8a", "c8b")).drop("k")

    return subsets.split_by_markers(_markers(spark, sf_dir), assign).select("id", "subset")


@query()
def ribosomal_filter(spark, sf_dir):
    x = cells.normalize_log1p(adapters.cell_gene(spark, sf_dir))
    named = x.withColumn("feature", F.concat(F.when(F.col("feature") % 4 == 0, "RPS").otherwise("G"), F.col("feature").cast("string")))
    return subsets.ribosomal_filter(named, 1.0)


@query()
def spread_labels(spark, sf_dir):
    r = adapters.receptors(spark, sf_dir)
    rows = r.select("id", F.md5("cdr3a").alias("p"), F.substring_index("va", "*", 1).alias("feature"), F.col("cg").alias("gex_cluster"), F.col("ct").alias("tcr_cluster"))
    return subsets.spread_labels(rows.unionByName(rows.withColumns({"p": F.md5("p"), "feature": F.lit("shared")})))


@query()
def redundant_features(spark, sf_dir):
    n = adapters.nodes(spark, sf_dir).select("id", F.col("gex").alias("x"))
    names = [f"g{k}" for k in range(1, 33)]
    corr = subsets.feature_correlation(n, names)
    heads, same = subsets.grouped_features(names, corr, 10)
    free = set(subsets.uncorrelated(names, corr, 0.1))
    return spark.createDataFrame([(f, f in free, f in heads, ",".join(same.get(f, []))) for f in names], "feature string, uncorrelated boolean, head boolean, stands_for string")
