"""Operators without SQL against brute force and golden values; defined edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bispace.functions import scores, stats, tails
from bispace.operators import aggregates, cells, clones, complexes, distances, genes, graph_tests, junctions, motifs, neighbours, reductions, sequences, subsets, trees, windows

PAIR = "id long, va string, cdr3a string, vb string, cdr3b string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# ---- distances ---------------------------------------------------------------------------------
def test_golden_paired_distance_and_bad_receptors(spark):
    a = [(1, "A1", "CAVEALTGGGNKLTF", "B1", "CASSAYTSGPKEQYF"), (3, "A1", "CAV", "B1", "CASSF"), (4, None, "CASSF", "B1", "CASSF"), (5, "A1", "CASSX", "B1", "CASSF"), (6, "zz", "CASSF", "B1", "CASSF")]
    b = [(2, "A2", "CAVPGITGGGNKLTF", "B2", "CASSLEQGPLQYF")]
    v = spark.createDataFrame([("A1", "A2", 6), ("B1", "B2", 55), ("A1", "A1", 0), ("B1", "B1", 0)], "v1 string, v2 string, d int")
    left, right = spark.createDataFrame(a, PAIR), spark.createDataFrame(b, PAIR)
    assert [tuple(r) for r in distances.radius_pairs(left, right, v, 187).collect()] == [(1, 2, 187)]
    assert distances.radius_pairs(left, right, v, 186).count() == 0 and distances.radius_pairs(left.limit(0), right, v, 500).count() == 0


def test_radius_and_nearest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 8)
    draw = random.Random(3)
    seq = lambda: "CA" + "".join(draw.choice("ADEG") for _ in range(draw.randint(3, 7))) + "TF"
    rows = [(k, f"V{k % 3}", seq(), f"W{k % 2}", seq()) for k in range(40)]
    v = {(f"{p}{a}", f"{p}{b}"): 5 * abs(a - b) for p in "VW" for a in range(3) for b in range(3)}
    df, vd = spark.createDataFrame(rows, PAIR), spark.createDataFrame([(*k, d) for k, d in v.items()], "v1 string, v2 string, d int")
    whole = {(x[0], y[0]): v[x[1], y[1]] + v[x[3], y[3]] + int(distances.cdr3_matrix([x[2]], [y[2]])[0, 0]) + int(distances.cdr3_matrix([x[4]], [y[4]])[0, 0]) for x in rows for y in rows}
    table = spark.createDataFrame([(x[2], y[2]) for x in rows for y in rows], "a string, b string").distinct()
    for r in table.select("a", "b", sequences.cdr3_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert distances.cdr3_matrix([r.a], [r.b])[0, 0] == r.d
    assert {(r.i, r.j): r.d for r in distances.radius_pairs(df, df, vd, 40, exclude=True).collect()} == {k: d for k, d in whole.items() if d <= 40 and k[0] != k[1]}
    got = {}
    for r in distances.receptor_knn(df, vd, 4, 8).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i in range(40):
        assert [j for _, j in sorted(got[i])] == [j for _, j in sorted((whole[i, j], j) for j in range(40) if j != i)[:4]]
    grouped = trees.greedy_clusters(df, vd, 40)
    matrix = np.array([[whole[i, j] for j in range(40)] for i in range(40)], float)
    want = {m: c for c, members in trees.greedy_groups(matrix, 40) for m in members}
    assert {r.id: r.center for r in grouped.collect()} == want


def test_alignment_puts_one_gap():
    score = {(a, a): 4 for a in "ACDEFGHIKLMNPQRSTVWY"}
    assert distances.align_cdr3("CAF", "CADEF", score) == ("CA..F", "CADEF") and distances.align_cdr3("CADEF", "CAF", score) == ("CADEF", "CA..F")
    assert distances.align_cdr3("CAF", "CDF", score) == ("CAF", "CDF")


def test_nodes_without_vectors_have_no_neighbours(spark):
    rows = [(1, 1, 1, [0.0, 1.0]), (2, 2, 2, None), (3, 3, 3, [0.0, 2.0]), (4, 4, 4, [None, 2.0])]
    df = spark.createDataFrame(rows, "id long, ag long, bg long, v array<double>")
    assert {(r.src, r.dst) for r in neighbours.exclusion_knn(df, "v", 2).collect()} == {(1, 3), (3, 1)}


# ---- tails and windows -------------------------------------------------------------------------
def test_batched_tails(spark):
    assert one(spark, tails.mann_whitney_tail(F.lit(0.0), F.lit(3), F.lit(3), F.lit(0.0))) == pytest.approx(0.0808555983700523)
    assert one(spark, tails.mann_whitney_tail(F.lit(18.0), F.lit(4), F.lit(5), F.lit(30.0), False)) == pytest.approx(0.030284430101328728)
    assert one(spark, tails.mann_whitney_tail(F.lit(2.0), F.lit(2), F.lit(2), F.lit(60.0))) == 1.0
    assert one(spark, tails.student_p(F.lit(2.0), F.lit(10))) == pytest.approx(0.0733880347707, rel=1e-9)
    assert one(spark, tails.student_p(F.lit(None).cast("double"), F.lit(10))) is None
    for t, df in ((0.7, 3.0), (2.5, 55.0), (40.0, 4.0), (0.0, 9.0)):
        assert one(spark, stats.student_two_sided(F.lit(t), F.lit(df))) == pytest.approx(tails.student_tail(np.array([t]), np.array([df]))[0], rel=1e-8)


def test_large_hypergeometric_tail(spark):
    n, m, d = 2_000_000, 300_000, 400_000
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    direct = math.fsum(math.exp(choose(m, j) + choose(n - m, d - j) - choose(n, d)) for j in range(60_300, 62_500))
    assert one(spark, stats.hypergeometric_tail(F.lit(60_300), F.lit(n), F.lit(m), F.lit(d))) == pytest.approx(direct, rel=1e-4)
    assert one(spark, stats.hypergeometric_tail(F.lit(1), F.lit(n), F.lit(m), F.lit(d))) == pytest.approx(1.0)
    assert one(spark, stats.hypergeometric_tail(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 1.0


def test_running_sums_over_ranges(spark):
    rows = [(k % 3, (k * 37) % 101, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(7)
    want = {(g, o): sum(v for h, p, v in rows if h == g and p <= o) for g, o, _ in rows}
    assert {(r.g, r.o): r.s for r in windows.running_sum(df, ["g"], [F.col("o")], F.col("v"), "s").collect()} == want
    least = {o: min(v for _, p, v in rows if p >= o) for _, o, _ in rows}
    assert {r.o: r.m for r in windows.least_from_here(df, [F.col("o")], "v", "m").collect()} == least


def test_cells_of_zeros(spark):
    counts = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "a", 3.0), (2, "b", 0.0)], "cell long, feature string, value double")
    x = {(r.cell, r.feature): r.x for r in cells.normalize_log1p(counts).collect()}
    assert x[1, "a"] == x[1, "b"] == 0.0
    assert cells.qc_filter(counts, F.lit(False), 1, 9, 0.5, 1).count() == 2
    assert {r.feature: r.dispersion for r in cells.dispersion(cells.normalize_log1p(counts), 2).collect()}["b"] is None


# ---- graphs ------------------------------------------------------------------------------------
def test_features_with_p_values_by_brute_force(spark):
    draw = np.random.default_rng(5)
    n = 30
    x = draw.normal(size=(n, 2))
    x[:6, 0] += 4
    edges = [(i, j, 1.0, k + 1) for i in range(n) for k, j in enumerate([j for j in range(n) if j // 6 == i // 6 and j != i])]
    e = spark.createDataFrame(edges, "src long, dst long, dist double, rank int")
    packed = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, x array<double>")
    got = {(r.id, r.feature): r for r in graph_tests.scores_on_graph(e, packed, ["hot", "cold"], 1.0).collect()}
    assert all((i, "hot") in got for i in range(6))
    fg, bg = x[:6, 0], x[6:, 0]
    t = (fg.mean() - bg.mean()) / math.sqrt(fg.var() / 6 + bg.var() / 24)
    u = sum((a > b) + 0.5 * (a == b) for a in fg for b in bg)
    p = 2 * 0.5 * math.erfc((abs(u - 72) - 0.5) / math.sqrt(6 * 24 / 12 * 31) / math.sqrt(2))
    assert got[0, "hot"].ttest_stat == pytest.approx(t) and got[0, "hot"].mwu_pvalue_adj == pytest.approx(p * 30 * 2)
    assert graph_tests.hotspot_packed(e, packed, ["hot", "cold"], 0.05).first().feature == "hot"


def test_cluster_interactions_peel_the_strongest(spark):
    rows = [(0, 0, k, k) for k in range(20)] + [(a, b, 100 + k, 100 + k) for k, (a, b) in enumerate(itertools.product((0, 1, 2), (1, 2), repeat=1)) for _ in (0,)] + [(1, 1, 200 + k, 200 + k) for k in range(9)]
    found = graph_tests.cluster_interactions(spark.createDataFrame(rows, "a long, b long, ag long, bg long"))
    assert (found[0]["a"], found[0]["b"], found[0]["overlap"]) == (0, 0, 20) and all(f["pvalue"] <= 1 for f in found)


def test_fractions():
    assert graph_tests.density_fraction([0.01, 0.1], 500) == 0.1 and graph_tests.density_fraction([0.01, 0.1], 5000) == 0.01 and graph_tests.density_fraction([0.01], 5) == 0.01
    assert graph_tests.raised_fractions([0.01, 0.1], 300, 10) == [0.033, 0.1]


def test_fitted_overlap_where_shuffling_would_take_too_long(spark):
    n = spark.createDataFrame([(k, k, k) for k in range(20)], "id long, ag long, bg long")
    e = spark.createDataFrame([(i, (i + d * d) % 20) for i in range(20) for d in (1, 2, 3) if (i * d) % 5], "src long, dst long")
    r = graph_tests.overlap_stats(e, e, n, 5, -1.0).first()
    assert r.overlap_zscore_source == "fitting" and r.overlap_zscore == r.overlap_zscore_fitted and r.overlap == r.gex_edges


# ---- subsets and features ----------------------------------------------------------------------
def test_spread_labels_by_plain_walk(spark):
    draw = random.Random(2)
    rows = [(round(draw.random(), 6), k, f"f{draw.randrange(6)}", k % 2, 0) for k in range(12) for _ in range(6)]
    want, shown, used = [], {}, set()
    for p, i, f, g, t in sorted(rows):
        pair = shown.setdefault((g, t), set())
        if len(pair) < 3 and f not in pair and i not in used:
            pair.add(f), used.add(i), want.append((p, i, f))
    df = spark.createDataFrame(rows, "p double, id long, feature string, gex_cluster long, tcr_cluster long")
    assert sorted((r.p, r.id, r.feature) for r in subsets.spread_labels(df).collect()) == sorted(want)


def test_redundant_features():
    corr = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1.0]])
    assert subsets.uncorrelated(["a", "b", "c"], corr) == ["a", "c"]
    assert subsets.grouped_features(["a", "b", "c"], corr, 2) == (["a", "c"], {"a": ["b"]}) and subsets.grouped_features(["a"], corr[:1, :1], 2) == (["a"], {})


def test_filters_refuse_and_keep(spark):
    df = spark.createDataFrame([(1, None, "TRBV1", 1), (2, "TRAV9", None, None)], "barcode long, va string, vb string, c int")
    assert subsets.without_v_genes(df, ["AV9"]).count() == 1 and subsets.without_clusters(df, "c", [1]).first().barcode == 2
    with pytest.raises(ValueError):
        subsets.at_least(df, 3, "cells")
    with pytest.raises(ValueError):
        subsets.without_invariant(df, "fish")
    with pytest.raises(ValueError):
        aggregates.check_raw_counts(spark.createDataFrame([(1, 2, 3.0)], "cell long, feature long, value double"))


def test_valley_between_two_peaks(spark):
    draw = np.random.default_rng(1)
    x = spark.createDataFrame([(float(v),) for v in np.concatenate([draw.normal(1, 0.2, 300), draw.normal(3, 0.2, 300)])], "x double")
    assert 1.5 < subsets.density_valley(x) < 2.5 and subsets.density_valley(x.limit(0)) == 2.0


# ---- clones, genes -----------------------------------------------------------------------------
def test_stringent_clones(spark):
    counts = [("c1", "A", "a1", 5), ("c1", "B", "b1", 5), ("c2", "A", "a1", 4), ("c2", "A", "a2", 9), ("c2", "B", "b1", 5), ("c3", "A", "a9", 1), ("c3", "B", "b1", 1), ("c4", "A", "a5", 1), ("c4", "B", "b5", 1), ("c5", "A", "a5", 1), ("c5", "B", "b5", 1)]
    bars = {"c1": 4, "c2": 6, "c3": 1, "c4": 2, "c5": 3}
    df = spark.createDataFrame(counts, "clone string, ab string, chain string, umis long")
    b = spark.createDataFrame([(c, [f"{c}-{k}" for k in range(n)]) for c, n in bars.items()], "clone string, barcodes array<string>")
    named, held = clones.stringent_clones(df, b)
    # (a1, b1) has ten cells, (a2, b1) six and so more than a third; (a9, b1) has one: refused
    got = {r.clone: (r.ta, r.ta2, r.tb, r.n_a, r.n_a2, r.n_b) for r in named.collect()}
    assert got == {"c2": ("a1", "a2", "b1", 10, 6, 16), "c5": ("a5", None, "b5", 5, 0, 5)}
    assert {r.clone: len(r.barcodes) for r in held.collect()} == {"c2": 10, "c5": 5}


def test_contigs_batches_and_consensus(spark):
    c = spark.createDataFrame([("k1", "AAA-1", "TRA", "v", "j", "CASSFF", "ACG", 3, True), ("k1", "AAA-1", "TRA", "none", "j", "CASSFF", "ACG", 3, True), ("k1", "AAB-1", "IGH", "v", "j", "CASSFF", "ACG", 3, True)], "clone string, barcode string, chain string, v_gene string, j_gene string, cdr3 string, cdr3_nt string, umis long, productive boolean")
    kept = clones.clean_contigs(c)
    assert [(r.ab, r.umis, r.cdr3_nt) for r in clones.chain_counts(kept).collect()] == [("A", 3, "acg")]
    assert clones.clone_barcodes(c).first().barcodes == ["AAA-1", "AAB-1"]
    assert clones.with_batch(c, "7").first().barcode == "AAA-7" and clones.with_batch(c, "7", "prefix", "prefix").first().barcode == "7-1" and clones.with_batch(c, "7").first().clone == "k1_7"
    s = spark.createDataFrame([("k1", "A", "v", "j", "x", "y", 9, 1), ("k1", "A", "v", "j", "x", "y", 2, 2), ("zz", "A", "v", "j", "x", "y", 2, 3)], "clone string, ab string, v_gene string, j_gene string, cdr3 string, cdr3_nt string, umis long, pos long")
    assert [r.umis for r in clones.consensus_umis(c, s).collect()] == [9]


def test_near_gene_representatives(spark):
    df = spark.createDataFrame([("V1*01", "A", "AAAA CC DD"), ("V1*02", "A", "AAAS CC DD"), ("V2*01", "A", "AATS CC DD"), ("V3*01", "A", "WWWW CC DD"), ("V4*01", "A", "AAA. CC DD")], "gene string, chain string, loops string")
    got = {r.gene: (r.rep, r.mm1_rep) for r in genes.representatives(df).collect()}
    assert got == {"V1*01": ("V1*01", "V1*01"), "V1*02": ("V1*02", "V1*01"), "V2*01": ("V2*01", "V2*01"), "V3*01": ("V3*01", "V3*01"), "V4*01": ("V4*01", "V4*01")}


# ---- strings, junctions, motifs ----------------------------------------------------------------
def test_translation_and_symbols(spark):
    lit = F.lit
    assert one(spark, scores.translate(lit("ATGTAAnn#gcn"))) == "M*#A" and one(spark, scores.translate(lit("ggcat"), -1)) == "M"
    assert one(spark, scores.translate(lit("ccatg"), 3)) == "M" and one(spark, scores.translate(lit(""))) == ""
    assert one(spark, scores.reverse_complement(lit("acgtrn"))) == "nyacgt"
    assert one(spark, scores.symbols_match(lit("r"), lit("a"))) and not one(spark, scores.symbols_match(lit("r"), lit("y")))
    assert [one(spark, scores.find_degenerate(lit(a), lit(b))) for a, b in (("rt", "ccat"), ("acgt", "acgt"), ("gg", "acgt"), ("acgta", "acgt"))] == [2, 0, -1, -1]


def test_junctions(spark):
    row = junctions.parse("tgtgccagcaaa", "tttacattc", "tgtgccagc" + "gacagg" + "c" + "cattc", {"D1": "gggacagggggc"})
    assert row["source"] == "VVVVVVVVV" + "D" * 6 + "N" + "J" * 5 and (row["v_trim"], row["j_trim"], row["n_dj"], row["d0_trim"], row["d1_trim"]) == (3, 4, 1, 2, 4)
    assert junctions.matched("acgt", "acct") == 2 and junctions.matched("", "a") == 0 and junctions.matched("rc", "ac") == 2
    assert junctions.masked("CAS", "VVVVNNVNN") == "-AS" and junctions.breakpoints("VNJ") == ({1, 2, -1, -2}, set())
    nt = junctions.back_translated("tgtgccagc", "tacattc"[1:], "CASGYF")
    assert one(spark, scores.translate(F.lit(nt))) == "CASGYF" and nt.startswith("tgtgccagc") and junctions.back_translated("tgt", "ttc", "CXF") is None


def test_planted_motif_is_found(spark):
    draw = random.Random(4)
    rest = lambda: "".join(draw.choice("ADEGHKLNPQRSTVY") for _ in range(7))
    fg = spark.createDataFrame([(k, "CAS" + "WMW" + rest() + "YF") for k in range(30)], "id long, seq string")
    bg = spark.createDataFrame([(k, "CAS" + rest() + "GGG" + "YF") for k in range(300)], "id long, seq string")
    found = motifs.enriched_motifs(fg, bg)
    assert found and found[0].fg == 30 and found[0].bg == 0 and motifs.overlap("W.A.G", "W.A..G") and not motifs.overlap("W.A.G", "W.A.G")
    assert motifs.enriched_motifs(fg.limit(0), bg) == []


# ---- complexes, trees, components --------------------------------------------------------------
def test_combined_p_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(complexes.greatest_p(F.lit(0.3), F.lit(4))) == pytest.approx(1 - 0.7**4) and one(complexes.greatest_p(F.lit(1e-9), F.lit(10**6))) == pytest.approx(1e-3, rel=1e-3)
    assert one(complexes.product_p(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.25 - 0.25 * math.log(0.25)) and one(complexes.product_p(F.lit(0.0), F.lit(1.0))) == 0


def test_peeled_p_values_by_a_sequential_walk(spark):
    draw = random.Random(9)
    nodes = [(i, draw.randrange(70), draw.randrange(70)) for i in range(120)]
    group = {i: (a, b) for i, a, b in nodes}
    edges = sorted({(i, j) for i in range(120) for j in draw.sample(range(120), 8) if i != j} | {(i, j) for i in range(8) for j in range(8) if i != j and i not in (3,)})
    pos = [(c, i) for c in "abcd" for i in draw.sample(range(120), 20)] + [("x", i) for i in range(8)] + [("x", i) for i in range(100, 106)]
    apart = lambda i, j: group[i][0] != group[j][0] and group[i][1] != group[j][1]
    want = {}
    for c in "abcdx":
        left = {i for d, i in pos if d == c}
        near = {i: {d for s, d in edges if s == i} for i in left}
        k, products = max(len(x) for x in near.values()), []
        while left:
            top = min(left, key=lambda i: (-len(near[i] & left), i))
            n, good, possible = len(near[top] & left), sum(apart(i, top) for i in left), sum(apart(i, top) for i in group)
            p = sum(math.comb(good, j) * math.comb(possible - good, k - j) for j in range(n, min(good, k) + 1)) / math.comb(possible, k)
            if not n or n * possible < good * k or p * len(left) > 1:
                break
            tail = 1 - (1 - p) ** len(left)
            x = products[-1] * tail if products else None
            products.append(tail if x is None else x - x * math.log(x))
            left = {i for i in left if i not in near[top] and apart(i, top)}
        want[c] = min(products, default=1.0)
    args = spark.createDataFrame(pos, "complex string, id long"), spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "id long, ag long, bg long")
    got = {r["complex"]: r.pvalue for r in complexes.peeled_p(*args).collect()}
    assert got == pytest.approx(want, rel=1e-6) and got["x"] < 1e-3 and min(want[c] for c in "abcd") <= 1
    assert complexes.peeled_p(args[0].limit(0), *args[1:]).count() == 0


def test_trees():
    d = np.array([[0, 1, 6, 9], [1, 0, 8, 9], [6, 8, 0, 9], [9, 9, 9, 0.0]])
    t = trees.tree(d, scores=[1, 2, 3, 4])
    assert trees.newick(t, "abcd").startswith("(((a:0.5,b:0.5)") and t.score == 2.5 and sorted(trees.leaf_order(t)) == [0, 1, 2, 3] and sum(trees.node_weights(t).values()) == 1
    assert trees.tree(d, "single").parts[0].distance == 6 and trees.tree(d).parts[0].distance == 7 and trees.tree(d, "geometric").parts[0].distance == pytest.approx(math.sqrt(48))
    assert trees.tree(np.zeros((0, 0))) is None and trees.percentile([3, 1, 2], 50) == 2


def test_kernel_components_give_the_gram_matrix(spark):
    draw = random.Random(6)
    rows = [(k, "V", "CAS" + "".join(draw.choice("ADEG") for _ in range(5)) + "TF", "W", "CASSF") for k in range(12)]
    df, v = spark.createDataFrame(rows, PAIR), spark.createDataFrame([("V", "V", 0), ("W", "W", 0)], "v1 string, v2 string, d int")
    x = np.array([r.kpc for r in reductions.kernel_components(df, v, 12).orderBy("id").collect()])
    d = distances.cdr3_matrix([r[2] for r in rows], [r[2] for r in rows]).astype(float)
    g = np.maximum(0, 1 - d / d.max())
    c = g - g.mean(0) - g.mean(1)[:, None] + g.mean()
    assert np.allclose(x @ x.T, c, atol=max(0.0, -np.linalg.eigvalsh(c).min()) + 1e-6)
    assert len(reductions.kernel_components(df, v, 3, landmarks=6).first().kpc) == 3 and reductions.kernel_components(df.limit(0), v).count() == 0


def test_label_clusters_of_two_cliques(spark):
    e = spark.createDataFrame([(i, j) for g in (range(6), range(6, 10)) for i in g for j in g if i != j] + [(5, 6)], "src long, dst long")
    got = {r.id: r.cluster for r in reductions.label_clusters(e, spark.range(10)).collect()}
    assert [got[k] for k in range(10)] == [0] * 6 + [1] * 4


def test_logo_of_aligned_members():
    score = {(a, a): 4 for a in "ACDEFGHIKLMNPQRSTVWY"}
    seqs = ["CAADF", "CAADF", "CADF", "CAAADF"]
    d = np.array([[0, 0, 12, 12], [0, 0, 12, 12], [12, 12, 0, 24], [12, 12, 24, 0]])
    medoid, letters, kinds = trees.logo_pwm(seqs, d, score, ["V" * 3 * len(s) for s in seqs])
    assert medoid == "CAADF" and letters[0] == {"C": 1.0} and letters[4] == {"F": 1.0} and sum(x.get(".", 0) for x in letters) == 0.25
    assert all(k == {"V": pytest.approx(1.0)} for k in kinds)
