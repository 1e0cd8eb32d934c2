"""Copies of a receptor are met once: the same results, however many copies there are."""

from collections import Counter

from bispace.operators import distances

CHAINS = [("TRAV1", "CAVNNARLMF", "TRBV1", "CASSLGQAYEQYF"), ("TRAV1", "CAVNNARLLF", "TRBV1", "CASSLGQAYEQYF"), ("TRAV2", "CAVRDSNYQLIW", "TRBV1", "CASSPGTGEYF")]


def copies(spark, n, first=0):
    rows = [(first + k, *CHAINS[k % 3], f"a{k % 3 + 3 * (k % 2)}", f"b{k % 3 + 3 * (k % 2)}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, va string, cdr3a string, vb string, cdr3b string, ag string, bg string")


def test_copies_are_one_kind(spark):
    v = spark.createDataFrame([(c, f"TR{c}V{x}", f"TR{c}V{y}", 12 * abs(x - y)) for c in "AB" for x in (1, 2) for y in (1, 2)], "chain string, v1 string, v2 string, d int")
    left, right = copies(spark, 60), copies(spark, 33, 1000)
    kinds, members = distances.kinds(left)
    assert sorted((r.id, r._n) for r in kinds.collect()) == [(0, 20), (1, 20), (2, 20)] and members.count() == 60
    assert distances.kinds(left, groups=True)[0].count() == 6
    pairs = distances.radius_pairs(left, right, v, None).collect()
    assert len(pairs) == 60 * 33
    assert {(x.id, x.d): x.n for x in distances.radius_counts(left, right, v, 500).collect()} == Counter((x.i, x.d) for x in pairs)
    each = {}
    for x in pairs:
        each.setdefault(x.i, []).append(x.d)
    assert {x.id: (x.n, x.least, x.most, x.total) for x in distances.distance_summary(left, right, v).collect()} == {k: (len(d), min(d), max(d), sum(d)) for k, d in each.items()}


def test_clumps_of_copies(spark):
    v = spark.createDataFrame([(c, f"TR{c}V{x}", f"TR{c}V{y}", 12 * abs(x - y)) for c in "AB" for x in (1, 2) for y in (1, 2)], "chain string, v1 string, v2 string, d int")
    r = copies(spark, 60)
    freqs = distances.background_frequencies(r, r, r, v, 24).withColumn("freq", distances.F.lit(1e-9))
    found, groups = distances.find_clumps(r, v, freqs, [12, 24])
    near = Counter((x.i, radius) for x in distances.radius_pairs(r, r, v, 24, exclude=True).collect() for radius in (12, 24) if x.d <= radius)
    assert near and {(x.id, x.radius): x.n_near for x in found.collect()} == near
    assert {x.id: x.clump for x in groups.collect()} == {k: 0 if k % 3 < 2 else 2 for k in range(60)}


def test_pairs_of_copies_are_met_once(spark, monkeypatch):
    v = spark.createDataFrame([(c, f"TR{c}V{x}", f"TR{c}V{y}", 12 * abs(x - y)) for c in "AB" for x in (1, 2) for y in (1, 2)], "chain string, v1 string, v2 string, d int")
    left, right = copies(spark, 61), copies(spark, 34, 1000)
    left = left.unionByName(left.where("id = 4").withColumn("cdr3a", distances.F.lit("CAVNNWRLLF")))  # an id twice, with two chains
    of = lambda df: [tuple(r) for r in df.select("id", "va", "cdr3a", "vb", "cdr3b", "ag", "bg").collect()]
    near = lambda x, y: 12 * (x[1] != y[1]) + int(distances.cdr3_matrix([x[2]], [y[2]])[0, 0]) + int(distances.cdr3_matrix([x[4]], [y[4]])[0, 0])
    apart = lambda x, y: x[5] != y[5] and x[6] != y[6]
    want = {e: Counter((x[0], y[0], near(x, y)) for x in of(left) for y in of(right) if near(x, y) <= 30 and (not e or apart(x, y))) for e in (False, True)}
    met, real = [], distances._packed
    monkeypatch.setattr(distances, "_packed", lambda r, *a: met.append(r.count()) or real(r, *a))
    for exclude, n in ((False, [4, 3]), (True, [7, 6])):
        met.clear()
        assert Counter(tuple(r) for r in distances.radius_pairs(left, right, v, 30, exclude=exclude).collect()) == want[exclude]
        assert met == n
    monkeypatch.setattr(distances, "LISTED", 3)
    assert Counter(tuple(r) for r in distances.radius_pairs(left, right, v, 30, exclude=True).collect()) == want[True]


def test_copies_are_projected_once(spark, monkeypatch):
    from bispace.operators import reductions

    v = spark.createDataFrame([(c, f"TR{c}V{x}", f"TR{c}V{y}", 12 * abs(x - y)) for c in "AB" for x in (1, 2) for y in (1, 2)], "chain string, v1 string, v2 string, d int")
    seen, real = [], reductions.of_members
    monkeypatch.setattr(reductions, "of_members", lambda rows, members: seen.append(rows.count()) or real(rows, members))
    got = {r.id: tuple(round(x, 9) for x in r.kpc) for r in reductions.kernel_components(copies(spark, 60), v, 2).collect()}
    assert seen == [3] and len(got) == 60 and all(got[k] == got[k % 3] for k in got) and len(set(got.values())) == 2  # two of the three chains differ in a trimmed letter only
