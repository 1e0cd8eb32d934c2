"""Operators 1, 3, 4 and 8 against the tokenizer library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bispace.llm import chat
from bispace.llm.bpe import Codec, encode_decode
from bispace.llm.token_counts import count_tokens
from bispace.llm.token_files import ByRank, Shard, pack, read_token_files, token_folder, write_token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "  a  b", "a \n b", "x\n \n y", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>c", "don't I'll \t\tx\x1cy", "日本語 ½ Ⅷ x²", "a" * 5000, "é  x", "　 a", "İΣΑΣ é", "the cat", "the cat"]


@pytest.fixture(scope="module")
def codec():
    with open(BYTE, "rb") as f:
        return Codec(f.read())


def test_codec_equals_library_on_random_texts(codec):
    library, draw = Tokenizer.from_file(BYTE), random.Random(5)
    letters = [*"ab eE'st\n\té½日🙂 1.,", "<|endoftext|>", "the", " and"]
    texts = [x or "" for x in ODD] + ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        own = np.frombuffer(ids, "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert own == want, text
        assert codec.decode(own) == library.decode(want, skip_special_tokens=False) == text


def test_rank_encoder_equals_library_where_proven():
    with open(BYTE, "rb") as f:
        data = f.read()
    assert ByRank.proven(data)
    library, draw = Tokenizer.from_file(BYTE), random.Random(6)
    letters = [chr(c) for c in (*range(0x20, 0x17F), 0x2028, 0x3000, 0x1F642, 0x65E5)]
    texts = [x or "" for x in ODD] + ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(2000)] + [" " * 3000, "a" * 9000]
    for text, ids in zip(texts, ByRank(data).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_shared_prefixes_equal_single_words(codec):
    words = {" the", " then", " thenceforth", " there", "x" * 300, "xy"}
    assert codec.encode_words(words) == {w: codec.encode_words({w})[w] for w in words}


def rows(spark):
    return spark.createDataFrame([(k if k else None, t, "own") for k, t in enumerate(ODD)], "doc_id long, text string, decoded string")


def test_bpe_operator_keeps_rows_and_replaces_clashing_names(spark):
    library = Tokenizer.from_file(BYTE)
    got = encode_decode(rows(spark), BYTE).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert encode_decode(rows(spark).limit(0), BYTE).count() == 0


def test_counts_equal_library(spark):
    library = Tokenizer.from_file(WORD)
    for r in count_tokens(rows(spark), WORD, sample_rows=3, limit=100).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 100)
    assert count_tokens(rows(spark).limit(0), WORD).count() == 0


def test_chat_spans_and_round_trip(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    talks = {1: [("user", said), ("assistant", said)], 2: [("assistant", ""), ("user", "<\\|x|> <"), ("assistant", "é\n🙂<"), ("assistant", "<\\\\|im_end|>")], 3: [("sys\ntem\\n", "x" * 9000)], 4: [("assistant", "same"), ("assistant", "same")]}
    table = [(c, k, r, t or None) for c, turns in talks.items() for k, (r, t) in enumerate(turns)] + [(None, 0, None, None)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").withColumn("formatted", chat.F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, BYTE)).collect()}
    assert got.keys() == {*talks, None} and [tuple(t) for t in got[None].turns] == [("", "")]
    for c, turns in talks.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert len(got[c].token_ids) == len(got[c].loss_mask)
    assert chat.format_conversations(df.limit(0), BYTE).count() == 0


def test_align_by_brute_force():
    draw = random.Random(3)
    for _ in range(300):
        cuts = sorted(draw.sample(range(1, 40), 8))
        offsets = list(zip([0, *cuts], [*cuts, 40], strict=True))
        a, b, c, d = sorted(draw.sample(range(41), 4))
        mask, covered = chat.align([(a, b), (c, d)], offsets)
        assert mask.tolist() == [int(any(s < y and x < e for x, y in ((a, b), (c, d)))) for s, e in offsets] and covered == [(a, b), (c, d)]


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(BYTE)
    folder = token_folder(spark)
    write_token_files(rows(spark), BYTE, folder, shard_bytes=64, ranges=3)
    start, want = 0, []
    for k, t in sorted(enumerate(ODD), key=lambda x: x[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((k or None, start, len(ids), zlib.crc32(np.array(ids, "<u4")), ids))
        start += len(ids)
    got = [tuple(r) for r in read_token_files(spark, folder, per_document=False).orderBy("start").collect()]
    assert got == want
    empty = token_folder(spark)
    write_token_files(rows(spark).limit(0), BYTE, empty)
    assert read_token_files(spark, empty).count() == 0


def test_shard_refuses_another_dictionary():
    import zstandard

    payload = pack([7], [b"\1\0\0\0"], [zstandard.compress(b"\1\0")], b"", 2)
    assert Shard(payload, b"").ids(0).tolist() == [1]
    with pytest.raises(ValueError):
        Shard(payload, b"other dictionary")
    assert hashlib.sha256(b"").digest() in payload


def test_id_lists_are_arrow_lists(codec):
    from bispace.llm.bpe import id_lists

    assert id_lists([]).to_pylist() == [] and isinstance(id_lists([b"\1\0\0\0"]), pa.ListArray)
