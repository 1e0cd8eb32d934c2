"""Thin queries that apply the operators to whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.chat import format_conversations, read_back

    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    back = read_back(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.bpe import encode_decode

    done = encode_decode(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.token_counts import count_tokens

    done = count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.token_files import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.decontaminate import find_leaks

    done = find_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "contaminated", "n_items", F.array_distinct("leaks.item_id").alias("item_ids"), F.coalesce(F.array_max("leaks.equal_words"), F.lit(0)).cast("long").alias("equal_words"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.common import crc_mod
    from bispace.llm.language_id import fit, identify

    documents = _read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    scorer = fit(documents.where(~held_out).select("doc_id", "text", "lang"))
    done = identify(documents.select("doc_id", held_out.alias("held_out"), "text"), scorer)
    return done.select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.licenses import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses", "sentence_ids", "fragments")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.lm_scoring import score

    return score(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.packing import pack

    packed = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, carry=("ids_crc32", "crc32(ids)"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.fill_middle import fill_in_middle, restored

    done = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, share=100, spm_share=50)
    sha = lambda c: F.sha2(c, 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bispace.llm.vector_codes import digest, vector_codes

    done, books = vector_codes(_read(spark, sf_dir, "embeddings"))
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op11_packing": op11_packing,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_vector_codes": op13_vector_codes,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op9_lm_scores": op9_lm_scores,
        "op2_near_dedup": op2_near_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op10_license_scan": op10_license_scan,
        "op1_chat_format": op1_chat_format,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_token_counts": op4_token_counts,
        "op8_token_files": op8_token_files,
    }


_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"length(regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g'))"



def _rounds(rounds: int) -> str:
    """SQL of operator 13: a book and its assignment for each round, and the last assignment."""
    nearest = "SELECT vec_id, part, d AS error, entry FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k]))) AS d FROM part_of p JOIN book{0} b USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    book = """SELECT part, entry, list(coalesce((s - ((s % c) + c) % c) // c, own) ORDER BY k) AS x FROM (SELECT b.part, b.entry, b.k, b.own, s.s, s.c FROM (SELECT part, entry, unnest(x) AS own, unnest(range(1, len(x) + 1)) AS k FROM book{0}) b
 LEFT JOIN (SELECT part, entry, k, CAST(sum(v) AS BIGINT) AS s, count(*) AS c FROM (SELECT a.part, a.entry, unnest(p.x) AS v, unnest(range(1, len(p.x) + 1)) AS k FROM near{0} a JOIN part_of p USING (vec_id, part)) GROUP BY part, entry, k) s USING (part, entry, k)) GROUP BY part, entry"""
    steps = [f"near0 AS MATERIALIZED ({nearest.format(0)})"]
    for r in range(rounds):
        steps += [f"book{r + 1} AS MATERIALIZED ({book.format(r)})", f"near{r + 1} AS MATERIALIZED ({nearest.format(r + 1)})"]
    return ",\n ".join(steps)


SQL = {
    "op12_fill_in_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 c AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t = '' OR right(t, 1) = chr(10) THEN 0 ELSE 1 END AS n, string_split(t, chr(10)) AS lines FROM d),
 r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS p, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS q, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 AS plain, CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM c),
 e AS (SELECT *, CASE WHEN least(p, q) = n THEN length(t) ELSE least(p, q) + coalesce(list_sum(list_transform(lines[1:least(p, q)], lambda x: length(x))), 0) END AS a, CASE WHEN greatest(p, q) = n THEN length(t) ELSE greatest(p, q) + coalesce(list_sum(list_transform(lines[1:greatest(p, q)], lambda x: length(x))), 0) END AS b FROM r),
 f AS (SELECT *, substring(t, 1, CAST(a AS BIGINT)) AS pre, substring(t, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS mid, substring(t, CAST(b AS BIGINT) + 1) AS suf FROM e)
 SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(b - a AS BIGINT) END AS middle_chars,
 sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM f""",
    "op13_vector_codes": f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 part_of AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 8 + 1 : (part + 1) * len(x) // 8] AS x FROM v, (SELECT unnest(range(8)) AS part)),
 book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM part_of WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
 {_rounds(6)},
 code AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near6 GROUP BY vec_id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book6) AS codebooks_sha256 FROM code JOIN v USING (vec_id)""",
    "op1_chat_format": f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')) t),
 o AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c)
 SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY k)) AS loss_sha256, CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + 1 + {_ESCAPED.format('r')} + {_ESCAPED.format('t')}) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id""",
    "op7_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
 reach AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.node), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
 SELECT node AS vec_id, coalesce(any_value(n), 0) AS n_links, min(c) AS component_id, node = min(c) AS kept FROM reach LEFT JOIN n ON n.a = node GROUP BY node""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
