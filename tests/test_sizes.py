"""Steps that must not grow faster than their input: counts leave tasks, texts are cut in one pass."""

import pytest

from bispace.operators import sequences


def test_letters_and_cores_are_counted_in_tasks(spark):
    seqs = ["CASSLEYF", "CAVRDDYTF", "CASSLEYF", "CA", "", None, "CASSEYQYFG", "ABCDEFé1F"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string").repartition(3)
    cores, places = {}, {}
    for s in filter(None, seqs):
        w = f"B{s[3 : max(3, len(s) - 2)]}Z"
        for k in range(len(w)):
            for x in (1, 2, 3):
                for y in (1, 2, 3):
                    if k + x + y < len(w):
                        c = w[k] + "." * (x - 1) + w[k + x] + "." * (y - 1) + w[k + x + y]
                        cores[c] = cores.get(c, 0) + 1
        for k, a in enumerate(s):
            places[len(s), k, a] = places.get((len(s), k, a), 0) + 1
    found = sequences.motif_cores(rows)
    assert {r.core: r.n for r in found.collect()} == cores
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    total = {}
    for (n, k, _), m in places.items():
        total[n, k] = total.get((n, k), 0) + m
    assert {(r.len, r.pos, r.letter): r.freq for r in sequences.pwm_by_length(rows).collect()} == pytest.approx({k: m / total[k[:2]] for k, m in places.items()})


def test_windows_cover_texts_in_one_pass(spark, tmp_path):
    from bispace.sources import adapters

    texts = ["ACDE", "A" * 12 + "CDEF", "C" * 12 + "DEFGH", "D" * 40, "", None, "ACD\nEF g" * 30, "E" * 29]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = adapters.windows(spark, str(tmp_path), "documents", "doc_id")
    assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.id, r.pos, r.seq) for r in found.collect())
    want = []
    for i, t in enumerate(texts):
        s = "".join(c for c in (t or "").upper() if c in sequences.ALPHABET)
        w = 12 + i % 5
        k = max(1, len(s) // w + (len(s) % w >= 5)) if s else 0
        want += [(i, p * w + 1, s[p * w : p * w + w] if p < k - 1 else s[p * w :]) for p in range(k)]
    assert got == want


def test_motifs_of_copies_are_searched_once(spark, monkeypatch):
    from bispace.operators import motifs

    some = ["CASSLEYGAEYF", "CASSLEYGSEYF", "CASSPQTRGEYF", "CASSLEWGAEYF"]
    rows = lambda seqs, n: spark.createDataFrame([(k, seqs[k % len(seqs)]) for k in range(n)], "id long, seq string")
    seen, real = [], motifs.core_occurrences
    monkeypatch.setattr(motifs, "core_occurrences", lambda df: seen.append(df.count()) or real(df))
    found = motifs.enriched_motifs(rows(some, 400), rows(["CASSDDDDDDYF", "CASSLEYGTTYF"], 600))
    assert seen == [4, 2] and found
    best = {m.cores: (m.fg, m.bg) for m in found}
    assert all(f <= 400 * 3 and f % 100 == 0 and b % 300 == 0 for f, b in best.values())
    assert motifs.upper_tail(3000, 5_400_000, 700_000, 1_000_000) == pytest.approx(1.0)
    assert motifs.upper_tail(2, 10, 4, 5) == pytest.approx(186 / 252) and motifs.upper_tail(5, 10, 4, 5) == 0.0


def test_sums_by_key_are_dealt_in_parts_of_given_size(spark):
    from pyspark.sql import functions as F

    from bispace.operators import cells, windows

    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    part, n = windows.dealt(df, "k", 300)
    assert n == 4 and part.rdd.getNumPartitions() == 4 and part.count() == 1000 and windows.dealt(df.limit(0), "k", 300)[1] == 1
    found = sequences.letter_counts(spark.createDataFrame([(1, "AAC"), (1, "CD"), (None, "A"), (2, "")], "id long, seq string"))
    assert {(r.id, r.letter): r.n for r in found.collect()} == {(1, "A"): 2, (1, "C"): 2, (1, "D"): 1, (None, "A"): 1}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    counts = spark.createDataFrame([(1, 10, 2.0), (1, 10, 1.0), (1, 3, 3.0), (2, 3, 5.0), (2, 4, 1.0), (3, 3, 1.0), (None, 3, 1.0), (None, 4, 1.0), (2, None, 9.0)], "cell long, feature long, value double")
    got = cells.qc_filter(counts, F.col("feature") % 10 == 0, 2, 7, 0.6, 1)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 6.0, 0.5), (2, 2, 6.0, 0.0)}


def test_plain_runs_are_found_by_search():
    import random

    from bispace.operators import junctions

    draw, met = random.Random(5), []
    for alphabet in ("acgt", "acgtnry"):
        for _ in range(300):
            a, b = ("".join(draw.choice(alphabet) for _ in range(draw.randrange(9))) for _ in range(2))
            size = draw.randrange(1, 5)
            want = [(s, p) for s in range(len(a) - size + 1) for p in range(len(b) - size + 1) if all(junctions.like(x, y) for x, y in zip(a[s : s + size], b[p : p + size], strict=True))]
            assert junctions.first_run(a, b, size) == (want[0] if want else None)
            met.append(bool(want))
    assert any(met) and not all(met)
