"""Windows met by tables of letters: every pair as in the join, counts in tasks, texts dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from bispace.operators import sequences
from bispace.plans import registry


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(7)
    text = lambda n: "".join(draw.choice(sequences.ALPHABET) for _ in range(n))
    rows = [[(k, p, text(draw.choice([4, 5, 6, 7, 8, 12, 13, 16, 20, 70]))) for k in range(12) for p in (1, 20)] for _ in range(2)]
    rows[0] += [(None, 1, rows[1][0][2]), (50, 1, rows[1][1][2])]
    return [spark.createDataFrame(r, "id long, pos long, seq string") for r in rows]


def joined(sides, radius):
    return sequences.radius_join(*(x.where("length(seq) >= 5").select(F.struct("id", "pos").alias("id"), "seq") for x in sides), radius)


@pytest.mark.parametrize("radius", [0, 72, 96, 900])
def test_tables_give_every_pair(spark, sides, radius):
    key = lambda df: sorted(map(str, df.collect()))
    want = key(joined(sides, radius))
    assert want and key(sequences.radius_windows(*sides, radius)) == want


@pytest.mark.parametrize("radius", [96, 900])
def test_background_and_score_are_counted_in_tasks(spark, sides, radius):
    m = joined(sides, radius)
    want = {(r.id.id, r.id.pos, r.dist): r.freq for r in sequences.background(m, m, 500, radius).collect()}
    got = sequences.window_background(*sides, 500, radius)
    assert {(r.id, r.pos, r.dist): r.freq for r in got.collect()} == pytest.approx(want) and want
    a, b = sequences.match_score(m, 48.0).first(), sequences.window_match_score(*sides, radius, 48.0).first()
    assert tuple(a)[:3] == tuple(b)[:3] and a.soft == pytest.approx(b.soft)


def test_texts_of_one_row_group_are_many_tasks(spark, tmp_path):
    text = "thenatandnanrthashteranwhethersaidit"
    docs = [(k, text[k % 9 :] * 3, "s") for k in range(200)]
    for name, rows in (("once", docs), ("twice", [*docs, docs[3]])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, text * 2), (1, "ACDEFGHIK")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        done = registry.queries()["background_convolution_whole"](spark, folder)
        assert ("hashpartitioning" in done._jdf.queryExecution().toString()) == (name == "twice")  # pairs aren't shuffled
        m = sequences.radius_windows(*registry._whole(spark, folder), 96)
        n = m.groupBy("i").count().where("count > 0").count()
        assert done.select("id", "pos").distinct().count() <= n
        assert registry.queries()["match_count_score_whole"](spark, folder).first().n_left == n
        tasks = registry.queries()["radius_matches_whole"](spark, folder).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 30
