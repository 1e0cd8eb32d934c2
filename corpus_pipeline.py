"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
rows of ``documents``; the last adds the token ids. Empty tables and empty texts follow the operators'
own definitions: a text without letters is rejected by the first stage; what has no words is no
duplicate; nothing else is dropped but duplicates and leaks. Of rows that repeat an id and a text one
stays; rows of a null id all stay; columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bispace.llm.bpe import encode_decode
from bispace.llm.decontaminate import find_leaks
from bispace.llm.language_id import fit, identify
from bispace.llm.near_dedup import near_duplicates
from bispace.session import work_dir, work_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of (id, hash, flag, count), some 50 bytes each, that the second stage broadcasts at most.
MARKS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language fits."""
    return identify(docs.select(*COLUMNS), fit(docs.select("doc_id", "text", "lang"))).where("not rejected").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: the smallest id, and of its texts one.

    Rows are dropped by id and text, so an id that also has a text of its own keeps that row. Rows of a
    null id all stay; only rows whose id is repeated are compared by their whole text.
    """
    docs = docs.select(*COLUMNS)
    marks = near_duplicates(docs.select("doc_id", "text"), by_row=True).where("doc_id is not null")
    marks = marks.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    # written and counted: up to MARKS rows go to all tasks, beyond that texts meet them by a shuffle
    marks = work_table(marks.where("not kept or n > 1"), "marks")
    marks = F.broadcast(marks) if marks.count() <= MARKS else marks
    same = (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h"))
    once = docs.join(marks.where("kept"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(marks, same, "left_anti").unionByName(once.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return find_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each whole text, and whether decoding them gives the text back."""
    done = encode_decode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(*COLUMNS, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("exact"))


STAGES = [("language_id", language), ("near_dedup", dedup), ("decontamination", decontaminate), ("bpe_encoding", encode)]

#: Trained models and consistent sampling aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
