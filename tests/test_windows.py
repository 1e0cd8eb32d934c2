"""Queries over whole texts: every letter is in a window, and later matches are seen."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bispace.functions.stats import poisson_tail
from bispace.operators import sequences
from bispace.plans import registry
from bispace.sources import adapters


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw, folder = random.Random(3), str(tmp_path_factory.mktemp("whole"))
    text = lambda n: "".join(draw.choice(sequences.ALPHABET + "bjo .") for _ in range(n))
    docs = [(k, text(draw.randint(0, 150)), f"s{k % 3}") for k in range(40)] + [(40, None, "s0"), (41, "ACD", "s0")]
    items = [(k, text(60)) for k in range(5)]
    docs.append((45, "W" * 60 + re.sub("[^A-Z]", "", items[0][1])[:12], "s1"))  # 5 windows of 12 letters before the match
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {k: re.sub(f"[^{sequences.ALPHABET}]", "", re.sub("[^A-Za-z]", "", t or "").upper()) for k, t, _ in docs}


def test_windows_hold_every_letter_once(spark, tables):
    folder, letters = tables
    got = {}
    for r in adapters.windows(spark, folder, "documents", "doc_id").orderBy("id", "pos").collect():
        assert r.pos == len(got.get(r.id, "")) + 1 and (len(r.seq) >= 5 or len(letters[r.id]) < 5) and len(r.seq) <= 20
        got[r.id] = got.get(r.id, "") + r.seq
    assert got == {k: s for k, s in letters.items() if s}
    counts = registry.queries()["letter_counts_whole"](spark, folder).collect()
    assert {(r.id, r.letter): r.n for r in counts} == {(k, c): n for k, s in letters.items() for c, n in Counter(s).items()}


def test_radius_of_whole_texts_equals_the_join(spark, tables):
    folder, _ = tables
    sides = [adapters.windows(spark, folder, *x).where("length(seq) >= 5").select(F.struct("id", "pos").alias("id"), "seq") for x in (("documents", "doc_id"), ("benchmark", "item_id"))]
    want = sorted((tuple(r.i), tuple(r.j), r.d) for r in sequences.radius_join(*sides, 72).collect())
    got = registry.queries()["radius_matches_whole"](spark, folder).collect()
    assert sorted(((r.i, r.i_pos), (r.j, r.j_pos), r.d) for r in got) == want
    assert any((r.i, r.i_pos, r.j, r.j_pos, r.d) == (45, 61, 0, 1, 0) for r in got)
    most = registry.queries()["match_count_score_whole"](spark, folder).first()
    assert most.matches == sequences.radius_join(*sides, 96).count() > len(want)
    assert registry.queries()["background_convolution_whole"](spark, folder).select("id", "pos").distinct().count() > 0


def test_strict_match_sees_every_position(spark, tables):
    folder, letters = tables
    rows = registry.queries()["strict_match_whole"](spark, folder).collect()
    assert any(r.item_id == 0 and r.pos == 1 for r in rows)
    for r in rows:
        assert r.ids == ",".join(str(k) for k in sorted(letters) if r.seq in letters[k])
    windows = adapters.windows(spark, folder, "documents", "doc_id").count() + adapters.windows(spark, folder, "benchmark", "item_id").count()
    assert 0 < registry.queries()["anti_merge_whole"](spark, folder).count() < windows
    assert registry.queries()["motif_core_counts_whole"](spark, folder).count() > 0


def test_pwm_counts_all_sequences_of_every_length(spark, tables):
    folder, _ = tables
    seqs = [r.seq for r in adapters.windows(spark, folder, "documents", "doc_id").collect()]
    n = Counter((len(s), k, c) for s in seqs for k, c in enumerate(s))
    lengths = Counter(map(len, seqs))
    got = {(r.len, r.pos, r.letter): r.freq for r in registry.queries()["pwm_whole"](spark, folder).collect()}
    assert len(lengths) > 5 and got == pytest.approx({k: v / lengths[k[0]] for k, v in n.items()}, abs=1e-9)


def test_poisson_tail_of_large_means(spark):
    cases = [(1, 1000.0), (950, 1000.0), (1000, 1000.0), (1100, 1000.0), (3, 0.5), (5, 7.0), (1, 1.5), (0, 9.0), (20000, 20100.0)]
    got = spark.createDataFrame(cases, "k long, mu double").select("k", "mu", poisson_tail(F.col("k"), F.col("mu")).alias("p")).collect()
    for r in got:
        lower = math.fsum(math.exp(-r.mu + j * math.log(r.mu) - math.lgamma(j + 1)) for j in range(r.k))
        assert r.p == pytest.approx(1 - lower, abs=1e-8)
