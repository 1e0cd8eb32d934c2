"""Operators 11, 12 and 13 against the library, plain sequential versions and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bispace.llm.fill_middle import fill_in_middle, restored
from bispace.llm.packing import best_fit, pack, plan, runs, sequences
from bispace.llm.vector_codes import BLOCK, assigned, build, digest, gathered, nearest, vector_codes

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def sequential_best_fit(counts, capacity):
    spaces, n = [], 0
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fits = [k for k, s in enumerate(spaces) if s >= length]
            if fits:
                k = min(fits, key=lambda k: spaces[k])
                spaces[k] -= length
            else:
                spaces.append(capacity - length)
                n += 1
    return n


def histograms():
    draw = np.random.default_rng(4)
    yield np.bincount(draw.integers(1, 65, 400), minlength=65)  # fills without waste
    yield np.bincount(draw.integers(17, 33, 300), minlength=65)  # waste can't be helped
    yield np.bincount(draw.integers(30, 64, 50), minlength=65)
    yield np.bincount([40] * 30 + [24] * 30 + [64] * 5, minlength=65)
    yield np.bincount([1] * 500 + [63] * 3, minlength=65)
    yield np.bincount([22] * 200 + list(draw.integers(1, 65, 100)), minlength=65)  # a hot length
    yield np.bincount([33], minlength=65)
    yield np.zeros(65, int)


def test_plans_cover_each_piece_once_within_the_capacity():
    for counts in histograms():
        done = plan(counts, 64)
        cover = Counter()
        for p, times in done.items():
            assert sum(i * c for i, c in p) <= 64 and times > 0
            for i, c in p:
                cover[i] += c * times
        assert cover == Counter({i: int(n) for i, n in enumerate(counts) if n})
        want = sequential_best_fit(counts, 64)
        assert best_fit(counts, 64).total() == want
        assert done.total() <= want + 1 and done.total() >= -(-int(counts @ np.arange(65)) // 64)


def test_plan_beats_best_fit_where_order_matters():
    counts = np.zeros(101, int)
    counts[[60, 45, 40, 30, 25]] = 300, 300, 200, 300, 300  # best fit pairs 60 with 40, the plan need not
    lower = -(-int(counts @ np.arange(101)) // 100)
    assert lower <= plan(counts, 100).total() <= sequential_best_fit(counts, 100)


def test_plan_size_is_bounded_and_grows_with_nothing():
    counts = np.bincount(np.random.default_rng(5).integers(1, 65, 4000), minlength=65)
    large = plan(counts * 10_000_000, 64)
    assert len(runs(large)) < 20_000 and large.total() <= best_fit(counts * 10_000_000, 64).total() * 1.001


ODD = [(1, "the cat sat"), (2, None), (3, ""), (None, "no id"), (5, "x " * 3000), (5, "again"), (5, "again"), (7, "é日🙂\n" * 400), (8, "<|endoftext|> a")] + [(10 + k, "word " * (k % 37)) for k in range(80)]


def test_packing_holds_every_token_once(spark):
    library = Tokenizer.from_file(BYTE)
    rows = spark.createDataFrame([(d, t, "x", -1, b"y") for d, t in ODD], "doc_id long, text string, part string, k long, ids binary").repartition(3)
    packed = pack(rows, BYTE, capacity=64)
    got = packed.collect()
    by_doc = defaultdict(list)
    for d, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        head = (len(ids) - 1) % 64 + 1
        starts = [0, *range(head, len(ids), 64)]
        by_doc[d] += [(k, s, ids[s:e]) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.length == len(r.ids) // 4
    assert {d: sorted(v) for d, v in mine.items()} == {d: sorted(v) for d, v in by_doc.items()}
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    counts = np.bincount([r.length for r in got], minlength=65)
    assert len(held) <= sequential_best_fit(counts, 64)
    for s in sequences(packed).collect():
        assert len(s.ids) == 4 * s.n_tokens and [p.offset for p in s.pieces] == sorted(o for o, _ in held[s.sequence_id])
    slim = pack(rows, BYTE, capacity=64, carry=("sum", "crc32(ids)"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length)
    assert sorted((*key(r), zlib.crc32(r.ids)) for r in got) == sorted((*key(r), r["sum"]) for r in slim.collect())
    assert pack(rows.limit(0), BYTE, capacity=64).count() == 0


TEXTS = [None, "", "\n", "\n\n", "a", "a\nb", "a\n\nb\n", "x <P> y", "<S>", "no <M>\n", "é日🙂\n🙂é", "<\nP>\n<S\n>", "  two  words\tand\nmore ", "long\n" * 5000, "tail <", "same\nrow", "same\nrow"]


def plain_fill(key, text, seed, share, spm, pattern):
    units = re.findall(pattern, text)
    h = [int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "pattern", "share"), [("line", r"[^\n]*\n|[^\n]+", 100), ("word", r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", 60), ("char", r"(?s).", 100)])
def test_fill_in_middle_by_regular_expression(spark, unit, pattern, share):
    rows = [(None if k == 4 else k, t, "own", 7) for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, extra long")
    done = fill_in_middle(df, seed=9, share=share, unit=unit).withColumn("back", restored(F.col("output"), F.col("form")))
    assert done.columns[:3] == ["doc_id", "text", "extra"]
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect())
    want = Counter()
    for d, t, _, _ in rows:
        want[(d, *plain_fill("" if d is None else d, t or "", 9, share, 50, pattern))] += 1
    assert got == want
    assert all((r.text or "") == r.back for r in done.collect())
    assert fill_in_middle(df.limit(0)).count() == 0


def test_fill_in_middle_refuses_what_cannot_be_undone(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fill_in_middle(df, unit="page")
    with pytest.raises(ValueError):
        fill_in_middle(df, sentinels=("<", "<S>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(df, sentinels=("aa", "b", "c"))


def test_filtering_equals_plain_assignment():
    draw = np.random.default_rng(6)
    for spread, n in ((3, 500), (1000, 700), (2, 33), (50, 1), (1, 200)):  # small grids are full of ties
        x = draw.integers(-spread, spread + 1, (n, 4)).astype(np.int32)
        book = np.concatenate([draw.integers(-spread, spread + 1, (6, 4)), x[:1], x[:1]]).astype(np.int64)
        tree = build(x)
        at, error = nearest(x, book)
        mine, squared = assigned(x, tree, book)
        assert (mine == at).all() and (squared == error).all()
        sums, counts = gathered(x, tree, book)
        assert (counts == np.bincount(at, minlength=8)).all()
        assert all((sums[k] == x[at == k].sum(0)).all() for k in range(8))


def test_filtering_skips_points():
    draw = np.random.default_rng(7)
    x = (draw.integers(0, 4, (2000, 1)) * 10_000 + draw.integers(0, 50, (2000, 2))).astype(np.int32)
    from bispace.llm.vector_codes import filtered

    _, lo, hi, _ = build(x)
    _, _, mixed = filtered(len(x), lo, hi, np.array([[k * 10_000 + 25] * 2 for k in range(4)], np.int64))
    assert len(mixed) <= 4  # far clusters are assigned whole


def plain_codes(rows, parts, entries, rounds):
    kept = sorted([r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    v = [[int(np.floor(4096 * x)) for x in r[1]] for r in kept]
    size = -(-len(v[0]) // parts)
    v = [x + [0] * (size * parts - len(x)) for x in v]
    cut = [[x[p * size : p * size + size] for p in range(parts)] for x in v]
    books = [[cut[k][p] for k in range(min(entries, sum(r[0] is not None for r in kept)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[best(p, x[p])].append(x[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])]
    out, by_label = [], Counter()
    for r, x in zip(kept, cut, strict=True):
        at = [best(p, x[p]) for p in range(parts)]
        error = sum(far(x[p], books[p][e]) for p, e in enumerate(at))
        by_label[r[2]] += error
        out.append((r[0], "".join(f"{e:02x}" for e in at), error, r[2]))
    return Counter((i, c, e, by_label[label]) for i, c, e, label in out), books


def test_vector_codes_by_plain_rounds(spark):
    draw = random.Random(8)
    rows = [(k if k % 9 else None, [draw.choice([draw.uniform(-1, 1), 0.25, -0.5]) for _ in range(10)], draw.choice([None, "a", "b"])) for k in range(150)]
    rows += [(200, [0.1] * 10, "a"), (200, [0.1] * 10, "a"), (200, [0.2] * 10, "a")]
    bad = [(300, None, "a"), (301, [], "a"), (302, [float("nan")] * 10, "b"), (303, [None] + [0.0] * 9, "b"), (304, [float("inf")] * 10, None)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows + bad], "vec_id long, embedding array<double>, label string, error long, id string").repartition(3)
    for entries in (1, 16):
        done, books = vector_codes(df, parts=4, entries=entries, rounds=3)
        want, plain = plain_codes(rows, 4, entries, 3)
        assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in done.collect()) == want
        assert [b.tolist() for b in books] == plain
        assert digest(books) == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()
    odd = df.where("vec_id < 3").select("vec_id", "embedding", "label").unionByName(spark.createDataFrame([(400, [1.0], "a"), (401, [1e300] * 10, "a")], "vec_id long, embedding array<double>, label string"))
    got = {r.vec_id: r.code for r in vector_codes(odd, parts=4)[0].collect()}
    assert got[400] is None and got[401] is None and got[1] and len(got) == 4
    assert vector_codes(df.limit(0))[0].count() == 0


def test_vectors_of_several_blocks(spark):
    df = spark.range(2 * BLOCK + 10).select(F.col("id").alias("vec_id"), F.array(*[(F.xxhash64("id", F.lit(k)) % 1000 / 1000).cast("float") for k in range(8)]).alias("embedding"), F.lit(None).cast("int").alias("label"))
    one, books = vector_codes(df.coalesce(1), rounds=2)
    many, again = vector_codes(df.repartition(7), rounds=2)
    assert digest(books) == digest(again) and one.exceptAll(many).count() == 0 and one.count() == 2 * BLOCK + 10
