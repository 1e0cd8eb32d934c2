"""Operators 2, 5, 6, 7, 9 and 10 and the pipeline against brute force and edge cases."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from bispace.llm import decontaminate, embedding_dedup, language_id, licenses, lm_scoring, near_dedup

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(draw, n, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def roots(nodes, links):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def corpus():
    draw, texts = random.Random(8), []
    for _ in range(25):
        base = prose(draw, draw.randint(6, 300)).split()
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(9999)}"
            texts.append(" ".join(copy))
    passage = prose(draw, 60)
    texts += [f"{prose(draw, 50)} {passage} {prose(draw, 50)}" for _ in range(30)]
    return [*texts, None, "", "!!!", "one two", "one two", "x " * 20000]


@pytest.mark.parametrize("block", [3, 256])
def test_near_dedup_by_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    weights = near_dedup.Weights(*near_dedup._frequencies(df.select("text")))
    sets = {k: near_dedup.counted_shingles(t)[:2] for k, t in enumerate(corpus)}
    sets = {k: (s, weights.of(s, n)) for k, (s, n) in sets.items() if len(s)}
    want = roots(range(len(corpus)), [(a, b) for a, b in itertools.combinations(sets, 2) if near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8])
    assert got == {k: (c, c == k) for k, c in want.items()}


def test_near_dedup_of_repeated_lines_by_brute_force(spark):
    draw, texts = random.Random(5), []
    for own in (60, 100, 200, 500, 1500):
        for _ in range(6):
            lines = f"{prose(draw, 12, 10**6)} " * 300
            texts += [lines + prose(draw, own, 10**6) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near_dedup.Weights(*near_dedup._frequencies(df.select("text")))
    sets = [(s, weights.of(s, n)) for s, n, _ in map(near_dedup.counted_shingles, texts)]
    want = roots(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near_dedup.weighted_jaccard(sets[a], sets[b]) >= 0.8])
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want
    assert len(set(want.values())) == 3 * 6 + 2 * 12


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, None, 0)], "doc_id long, text string, class_id int")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect()) == [(0, 1, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sampling_matches_jaccard():
    draw = np.random.default_rng(4)
    a = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    b = np.concatenate([a[:3000], draw.integers(0, 1 << 63, 1000).astype(np.uint64)])
    equal = []
    for k in range(30):
        s = np.concatenate([a, b]) + np.uint64(k)
        d = near_dedup.sample(near_dedup.mix64(s), np.ones(len(s)), np.repeat([0, 1], 4000), 2)
        equal.append((d[0] == d[1]).mean())
    assert np.mean(equal) == pytest.approx(0.6, abs=0.03)


def test_draws_of_short_texts_are_independent():
    draw = np.random.default_rng(9)
    for n in (5, 10, 15, 20):  # similarity 0.8 by one differing shingle in five
        texts, short = 1500, n * 4 // 5
        s = near_dedup.mix64(draw.integers(0, 1 << 63, (texts, n)).astype(np.uint64))
        both = np.concatenate([s[:, :short].ravel(), s.ravel()])
        owner = np.concatenate([np.repeat(np.arange(texts), short), np.repeat(np.arange(texts, 2 * texts), n)])
        d = near_dedup.sample(both, np.ones(len(both)), owner, 2 * texts)
        equal = (d[:texts] == d[texts:]).sum(1)
        assert equal.min() >= 32 and equal.mean() == pytest.approx(0.8 * 64, abs=0.5) and equal.std() == pytest.approx(3.2, abs=0.3)


def test_leaks_tolerate_substitutions_only(spark):
    draw = random.Random(2)
    items = {k: prose(draw, 20, 5000) for k in range(30)} | {77: "tiny item here"}
    docs = {}
    for k in range(10):
        docs[k] = f"{prose(draw, 40, 5000)} {items[k]} {prose(draw, 40, 5000)}", {k}
    for k in range(10, 20):
        words = items[k].split()
        for at in draw.sample(range(20), 3):
            words[at] = "zzz"
        docs[k] = f"{prose(draw, 9, 5000)} {' '.join(words)}", {k}
    for k in range(20, 25):
        docs[k] = f"{' '.join(items[k].split()[:6])} {prose(draw, 90, 5000)}", set()
    docs |= {30: (None, set()), 31: ("", set()), 32: ("a tiny item here too", {77}), 33: ("z " * 30000, set())}
    bench = spark.createDataFrame([*items.items(), (None, "a b c d e"), (99, None)], "item_id long, text string")
    df = spark.createDataFrame([(k, t, 1) for k, (t, _) in docs.items()], "doc_id long, text string, leaks int")
    for size in (2_000_000, 300):
        for r in decontaminate.find_leaks(df, bench, slice_seeds=size).collect():
            assert {x.item_id for x in r.leaks} == docs[r.doc_id][1] and r.contaminated == bool(r.leaks) and r.n_items == len(r.leaks)
    assert not any(r.contaminated for r in decontaminate.find_leaks(df, bench.limit(0)).collect())
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_leaks_by_brute_force_over_all_stretches():
    draw, found = random.Random(12), 0
    changed = [[k >= 20 and k % 3 == 1 for k in range(80)]]  # a verbatim head, a reworded rest
    for share in (0.15, 0.2, 0.25, 0.35):
        changed += [[draw.random() < share for _ in range(draw.randint(16, 59))] for _ in range(250)]
    for c in changed:
        item = [f"w{k}" for k in range(len(c))]
        text = " ".join(["before", *(f"x{k}" if x else f"w{k}" for k, x in enumerate(c)), "after"])
        equal = np.cumsum([0, *(not x for x in c)])
        most = max((n for a in range(len(c)) for b in range(a + 1, len(c) + 1) if 5 * (n := int(equal[b] - equal[a])) >= 4 * (b - a)), default=0)
        want = [most] if most >= 13 or 5 * most >= 4 * len(c) else []
        got = decontaminate.Index([(7, decontaminate.word_hashes(" ".join(item)).tobytes())], 13, 0.8, 3).search(decontaminate.word_hashes(text))
        assert [n for _, _, _, n in got] == want
        assert all(n == equal[b - 1] - equal[a - 1] and 5 * n >= 4 * (b - a) for _, a, b, n in got)
        found += len(want)
    assert 300 < found < 950


def test_short_items_and_items_without_id(spark):
    for n in range(3, 16):
        item = np.arange(n).astype(np.uint64) + np.uint64(1000)
        index = decontaminate.Index([(7, item.tobytes())], 13, 0.8, 3)
        for changed in (c for k in range(4) for c in itertools.combinations(range(n), k)):
            text = item.copy()
            text[list(changed)] = 5
            assert bool(index.search(text)) == (5 * (n - len(changed)) >= 4 * n)
    bench = spark.createDataFrame([(None, "a b c d e f g"), (3, "h i j k l m n")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b X d e f g"), (2, "X h i Y k l m n a b c d e f g"), (3, "a b c h i")], "doc_id long, text string")
    got = {r.doc_id: ({x.item_id for x in r.leaks}, r.n_items) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {1: ({None}, 1), 2: ({None, 3}, 2), 3: (set(), 0)}


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = language_id.F.col("doc_id") % 4 == 2
    scorer = language_id.fit(df.where(~held))
    got = language_id.identify(df.where(held), scorer).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !!", "x"), (4, "жзщ ъэю ыфх жзщ", "x")], "doc_id long, text string, lang_pred string")
    rows = {r.doc_id: r for r in language_id.identify(odd, scorer).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].rejected for k in (1, 2, 3)) and rows[4].rejected
    assert [r.lang_pred for r in language_id.identify(odd, language_id.fit(df.limit(0))).collect()] == ["und"] * 4


def test_character_model_is_a_distribution():
    model = language_id.Model(["abab", "abc", "ba"], [3, 1, 2])
    grams, word = language_id._grams(["ab" + chr(c) for c in range(97, 123)] + ["ab"])
    logs = model.log_p(grams, language_id._histories(grams))
    after = np.concatenate([[-1], word])[:-1]
    third = [k for k in range(len(word)) if word[k] >= 0 and k >= 3 and word[k - 1] == word[k] and word[k - 2] == word[k] and (k < 4 or word[k - 3] < 0)]
    assert len(after) == len(logs) and 0.9 < np.exp(logs[third]).sum() <= 1 + 1e-9


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    draw = np.random.default_rng(6)
    rows = []
    for _ in range(60):
        center, label = draw.normal(size=16), int(draw.integers(0, 3))
        for _ in range(int(draw.integers(1, 8))):
            rows.append((center + draw.normal(size=16) * draw.choice([0, 0.2, 0.3]), label))
    table = [(k, [float(np.float32(x)) for x in v], l) for k, (v, l) in enumerate(rows)]
    n = len(table)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None] * 8, 1), (n + 4, table[0][1], None), (n + 5, [1.0] * 3, 1), (n + 6, [2.0] * 3, 1), (n + 7, [], 1)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<float>, label int").withColumn("n_links", language_id.F.lit("own"))
    x = np.array([t[1] for t in table])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if table[i][2] == table[j][2] and x[i] @ x[j] >= 0.93] + [(n + 5, n + 6)]
    links, want = Counter(k for p in pairs for k in p), roots(range(n + 8), pairs)
    got = embedding_dedup.near_duplicate_vectors(df).collect()
    assert len(got) == n + 8 and len(pairs) > 100
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (links[k], c, c == k) for k, c in want.items()}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def segmentations(text, pieces):
    """All ways to cut a word into pieces, as lists of names; a character without a piece is its bytes."""
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            yield from ([text[:k], *rest] for rest in segmentations(text[k:], pieces))
    if text and text[0] not in pieces:
        yield from ([*(f"<0x{b:02X}>" for b in text[0].encode()), *rest] for rest in segmentations(text[1:], pieces))


def fitted(words, ends, rounds):
    """Piece probabilities by enumeration of all segmentations of all training words."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    pieces = {n for i, n in enumerate(names) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i)}
    cuts = {w: list(segmentations("▁" + w, pieces)) for w in words}
    count = Counter()
    for w, n in words.items():
        for i in library.encode(w):
            count[names[i]] += n
    for r in range(rounds + 1):
        total = sum(count.values()) + ends + 0.1 * (len(names) + 1)
        p = {n: (count[n] + 0.1) / total for n in names}
        if r < rounds:
            count = Counter()
            for w, n in words.items():
                weigh = [math.prod(p[x] for x in c) for c in cuts[w]]
                for c, x in zip(cuts[w], weigh, strict=True):
                    for name in c:
                        count[name] += n * x / sum(weigh)
    marginal = lambda w: math.log10(sum(math.prod(p[x] for x in c) for c in segmentations("▁" + w, pieces)))
    return marginal, math.log10((ends + 0.1) / total)


def test_lm_scores_by_brute_force(spark):
    texts = ["The cat sat", "the CAT\tran", None, "", "é 日本 zq ⠿x", "the the the", *(f"w{k} the a{k}" for k in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*lm_scoring.words_of(t), b""])
    n, v = sum(count.values()), len(count)
    marginal, end = fitted({w.decode(): c for w, c in count.items() if w}, count[b""], lm_scoring.EM_ROUNDS)
    share = v / (n + v)
    for table in (5, 100_000):
        got = lm_scoring.score(df, PIECES, table_size=table).collect()
        assert len(got) == len(texts)
        for r in got:
            words = lm_scoring.words_of(texts[r.doc_id])
            own = {w: marginal(w.decode()) for w in words}
            assert (r.n_tokens, r.train_tokens, r.n_known) == (len(words) + 1, n, sum(count[w] > 0 for w in [*words, b""]))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words, b""]))
            assert r.score == pytest.approx(sum(own[w] for w in words) + end)
            assert r.mixture_score == pytest.approx(sum(math.log10((1 - share) * count[w] / n + share * 10 ** own[w]) if count[w] else math.log10(share) + own[w] for w in words) + end)
    assert lm_scoring.score(df.limit(0), PIECES).count() == 0


def test_lm_scores_of_a_very_long_word_and_text(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (3, "the cat " * 4000), (4, "the cat")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(df, PIECES).collect()}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values()) and got[3].n_tokens == 8001


def test_lattice_sums_all_segmentations():
    with open(PIECES, "rb") as f:
        data = f.read()
    counts = np.random.default_rng(1).random(lm_scoring.Pieces(data).size + 1) * 50
    lattice = lm_scoring.Lattice(data, counts)
    for word in ("the", "tion", "cats"):
        text, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            if all(p in lattice.pieces for p in parts):
                total += math.exp(sum(lattice.pieces[p] for p in parts))
        assert lattice.word(word.encode()) == pytest.approx(math.log10(total))


def test_license_rules(spark):
    s = licenses.SENTENCES
    texts = {1: f"Intro text.\n{s['apache-short']}\nMore.", 2: "\n".join(s[k].upper() for k in ("mit-grant", "mit-notice", "mit-asis")), 3: s["mit-notice"], 4: None, 5: "", 6: f"{s['gpl3-short']} {s['cc-by-nc-short']}", 7: "license " * 9000, 8: "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))}
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, licenses int")).collect()}
    want = {1: ["Apache-2.0"], 2: ["MIT"], 3: [], 4: [], 5: [], 6: ["GPL-3.0-only", "CC-BY-NC-4.0"], 7: [], 8: ["BSD-2-Clause"]}
    assert {k: r.licenses for k, r in got.items()} == want and got[3].fragments == ["mit-notice"]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 0.8 * n < len(out) < n and len({r.doc_id for r in out}) == len(out) and all(r.exact for r in out)
    bench = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert not any(b in r.text for b in bench for r in out)
