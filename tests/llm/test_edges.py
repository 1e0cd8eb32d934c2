"""Defined cases and independent brute force of the corpus operators, beside the other tests."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bispace.llm import chat, language_id, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def folder_of(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# ---- operator 1 --------------------------------------------------------------------------------
def test_chat_query_by_brute_force(spark, tmp_path):
    draw = random.Random(1)
    odd = ["", None, "\n\n  lead", "trail \n", "<|im_sep|>", "<\\|im_end|>", "é🙂", "a" * 4000, " ", "<|", "x<|im_start|>assistant"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", None, "as|<|im_sep|>"]), draw.choice(odd)) for c in range(40) for t in range(draw.randint(1, 6))]
    rows += [(50, 0, "assistant", "tie"), (50, 0, "assistant", "tie"), (50, 0, "assistant", "same turn"), (None, 1, "assistant", "no id")]
    path = folder_of(spark, tmp_path, conversations=(rows, "conv_id long, turn long, role string, text string"))
    said = "<|im_end|><|im_start|>assistant ok"
    talks = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        talks[c].append((t, r is not None, r or "", x is not None, x or ""))
    got = {r.conv_id: r for r in queries.op1_chat_format(spark, path).collect()}
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        turns = [(r, x) for _, _, r, _, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_loss_text_follows_the_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", " hi "), (1, 1, "assistant", "\n ok, é🙂\n")], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df, BYTE)
    assert chat.read_back(done).first().loss_text == "\n ok, é🙂\n"
    assert chat.read_back(done.withColumn("loss_mask", F.transform("loss_mask", lambda x: x * 0))).first().loss_text == ""


# ---- operator 6 --------------------------------------------------------------------------------
def test_numerals_are_no_letters(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(["½ ²", "Ⅷ", "12 _", None, "a½", "日本"])], "doc_id long, text string, lang string")
    scorer = language_id.fit(spark.createDataFrame([(1, "ab cd ab", "x"), (2, "日本 日本", "y")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language_id.identify(df, scorer).orderBy("doc_id").collect()] == ["und"] * 4 + ["x", "y"]


def kneser_ney(words):
    """Interpolated Kneser-Ney over characters by dictionaries of strings: probability of a letter after a history."""
    order, padded = language_id.ORDER, [("\x02" + w + "\x03", n) for w, n in words.items()]
    counts = [Counter() for _ in range(order + 1)]
    for w, n in padded:
        for end in range(1, len(w)):
            for size in range(1, min(order, end + 1) + 1):
                counts[size][w[end - size + 1 : end + 1]] += n
    for size in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in counts[size + 1])
        for g in counts[size]:
            counts[size][g] = before.get(g, counts[size][g])
    discount = [0.0] * (order + 1)
    for size in range(1, order + 1):
        ones, twos = (sum(v == k for v in counts[size].values()) for k in (1, 2))
        discount[size] = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))

    def p(text, size):
        if size == 0:
            return 1 / language_id.ALPHABET
        lower = p(text[1:], size - 1)
        head = {g: c for g, c in counts[size].items() if g[:-1] == text[:-1]}
        if not head:
            return lower
        total = sum(head.values())
        return max(head.get(text, 0) - discount[size], 0) / total + discount[size] * len(head) / total * lower

    return lambda w: sum(math.log(p(x[max(0, e - order + 1) : e + 1], min(order, e + 1))) for x in ["\x02" + w + "\x03"] for e in range(1, len(x)))


def test_character_models_by_direct_formula():
    draw = random.Random(4)
    words = Counter("".join(draw.choices("abcdé", k=draw.randint(1, 6))) for _ in range(60))
    model, direct = language_id.Model(list(words), list(words.values())), kneser_ney(words)
    scorer = language_id.Scorer({"x": model})
    for w in [*words, "zzz", "abz", "q", "dcba", "aaaaaaa"]:
        chars, log_p = scorer.words([w])[0]
        assert chars == len(w) + 1 and log_p == pytest.approx(direct(w), rel=1e-9)


def test_rows_without_id_are_sampled_one_by_one(spark):
    df = spark.createDataFrame([(None, f"ab{k} cd ab", "x") for k in range(900)], "doc_id long, text string, lang string")
    scorer = language_id.fit(df, rows_per_language=100)
    assert scorer.names == ["x"]
    got = language_id.identify(df, scorer).collect()
    assert len(got) == 900 and {r.lang_pred for r in got} == {"x"}


# ---- operators 2, 5, 7, 10 ---------------------------------------------------------------------
def test_ids_with_several_texts_join_no_unrelated_classes(spark):
    from bispace.llm.near_dedup import near_duplicates

    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (4, "c d e f g h"), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 3, True), (1, 2, False), (1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)]


def test_leaks_by_brute_force_over_all_diagonals(spark):
    from bispace.llm.decontaminate import find_leaks

    draw = random.Random(21)
    word = lambda: f"w{draw.randrange(4000)}"
    items = {k: [word() for _ in range(draw.randint(5, 40))] for k in range(12)}
    docs = {}
    for k in range(60):
        words = [word() for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 2)):
            own = list(items[draw.randrange(12)])
            for at in range(len(own)):
                if draw.random() < draw.choice([0, 0.1, 0.2]):
                    own[at] = "other"
            at = draw.randint(0, len(words))
            words[at:at] = own
        docs[k] = words
    want = {}
    for k, words in docs.items():
        want[k] = set()
        for i, item in items.items():
            need = min(13, 0.8 * len(item))
            for shift in range(-len(item) + 1, len(words)):
                equal = [0, *itertools.accumulate(int(0 <= p + shift < len(words) and words[p + shift] == w) for p, w in enumerate(item))]
                lo, hi = max(0, -shift), min(len(item), len(words) - shift)
                if any((n := equal[y] - equal[x]) >= need and 5 * n >= 4 * (y - x) for x in range(lo, hi) for y in range(x + 1, hi + 1)):
                    want[k].add(i)
    df = spark.createDataFrame([(k, " ".join(w), k) for k, w in docs.items()], "doc_id long, text string, _row long")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    for size in (2_000_000, 200):
        got = find_leaks(df, bench, slice_seeds=size)
        assert got.columns == ["doc_id", "text", "_row", "leaks", "n_items", "contaminated"]
        assert {r.doc_id: {x.item_id for x in r.leaks} for r in got.collect()} == want
    assert sum(map(bool, want.values())) > 15


def test_vectors_that_share_an_id_keep_their_own_links(spark):
    from bispace.llm.embedding_dedup import near_duplicate_vectors

    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, x, 0), (1, y, 0), (2, x, 0), (3, y, 0), (4, [0.0, 0.0, 1.0], 0), (5, x, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_licences_by_containment(spark):
    from bispace.llm.licenses import RULES, SENTENCES, normalise, scan_licenses

    draw = random.Random(9)
    names = sorted(SENTENCES)
    texts = {}
    for k in range(60):
        lines = []
        for _ in range(draw.randint(0, 5)):
            lines.append(draw.choice([f"some words {draw.random()}.", SENTENCES[draw.choice(names)], *(SENTENCES[s] for s in draw.choice(RULES)[1])]))
        texts[k] = "\n".join(lines)
    folded = SENTENCES["mit-grant"].replace(" to deal ", "\n to deal ") + "\n" + SENTENCES["mit-notice"].replace(" this ", "\n this ") + "\n" + SENTENCES["mit-asis"]
    rows = [*texts.items(), (None, folded), (None, folded), (99, None)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    known = {normalise(s): n for n, s in SENTENCES.items()}
    for r in got:
        if r.doc_id is None:
            assert r.licenses == ["MIT"]
            continue
        # sentences by containment: each line of these texts is one sentence
        ids = [known[n] for n in map(normalise, (texts.get(r.doc_id) or "").split("\n")) if n in known]
        assert list(r.sentence_ids) == ids
        want, at = [], 0
        while at < len(ids):
            best = max((rule for rule in RULES if tuple(ids[at : at + len(rule[1])]) == tuple(rule[1])), key=lambda rule: len(rule[1]), default=None)
            if best:
                want.append(best[0])
            at += len(best[1]) if best else 1
        assert list(r.licenses) == want
    assert len(got) == len(rows) and scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------
def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 300 and 3000").limit(40).collect()
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "more") for r in source]
    first = docs[0]
    docs += [first, first, (9001, first[1], first[2], None, None, "copy"), (None, docs[1][1] + " again and again", first[2], "s", 1, "x"), (9002, None, "en", "s", 0, "x"), (9003, "", "en", "s", 0, "x"), (9004, "12 !!", None, "s", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    path = folder_of(spark, tmp_path, documents=(docs, schema), benchmark=([(1, docs[2][1]), (None, None)], "item_id long, text string"))
    out = corpus_pipeline.run(spark, path).collect()
    ids = Counter(r.doc_id for r in out)
    assert ids[first[0]] == 1 and not ids.keys() & {9001, 9002, 9003, 9004, docs[2][0]} and ids[None] <= 1
    assert max(ids.values()) == 1 and all(r.exact and r.n_tokens == len(r.token_ids) for r in out) and len(out) > 20
    empty = folder_of(spark, tmp_path, documents=([], schema), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_dedup_drops_rows_and_not_ids(spark):
    """An id with a text of its own and a copied one keeps its own; of a class one row stays."""
    import corpus_pipeline

    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in ("ash", "beech", "cedar"))
    near = a.rsplit(" ", 1)[0] + " elm"
    tables = [
        ([(1, a), (1, b), (2, b)], [{(1, a), (2, b)}]),
        ([(1, a), (1, near)], [{(1, a)}, {(1, near)}]),
        ([(3, a), (3, b), (4, a), (4, b), (5, c)], [{(3, a), (3, b), (5, c)}]),
        ([(None, a), (None, a), (6, a), (7, near), (8, None), (8, ""), (9, "")], [{(None, a), (6, a), (8, None), (8, ""), (9, "")}]),
    ]
    for rows, wanted in tables:
        df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 0, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, d int, h int")
        got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, df, "").collect()]
        assert set(got) in wanted and len(got) == len(set(got)) + got.count((None, a)) // 2
