"""Operator 8 - token ids in binary shards, each document compressed with one shared dictionary.

A zstandard dictionary is trained on the serialized id arrays of about ``sample_rows`` rows, drawn
evenly from the whole table. Documents are dealt to ranges of ascending doc_id, encoded, closed with the end
id, compressed one by one, and packed into shards of bounded size. A shard carries the dictionary's
hash and an offset index, so a short document is read without its neighbours. Ids come from merging
by rank where the driver has proven that for the vocabulary, else from the codec of operator 3. Shards are binary
rows of Parquet files, so any store that Spark writes to holds them, and a lost executor's task is
simply written again.

Shard: magic ``TOKS1``, item size (2 or 4), dictionary SHA-256, number of documents, then the index
(doc_id int64 each, null flags, token counts int64, offsets int64, one more at the end), frames.

Defined cases: null texts hold the end id alone; a null doc_id sorts first; repeated doc_ids keep
one entry per row, ties ordered by a hash of their text; an empty table gives no shards; extra columns are ignored;
texts of any length are one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bispace.llm.bpe import PRETOKEN, Codec, codec, slices
from bispace.llm.common import Shared, broadcast_key, file_broadcast, spread, worker_state
from bispace.session import work_dir

MAGIC = b"TOKS1"
#: Bytes of text in a range of documents; the tasks of larger tables stay as large, there are more.
RANGE_BYTES = 128 << 20
_HEAD = struct.Struct("<5sB32sQ")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for serialized id arrays; too few samples give raw content instead."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


class ByRank:
    """Encoder that merges whatever adjacent pair makes the earliest token, by the tiktoken library.

    It gives the ids of the vocabulary's own merges exactly if ``proven`` holds: no other pair of
    tokens that spells a token can ever be adjacent, and each token encodes as itself.
    """

    #: Texts with a run of one kind of character as long as this go to the plain codec.
    RUN = regex.compile(r"\p{White_Space}{2000}|[^\p{White_Space}]{2000}")
    #: Such a run holds one of these at a multiple of their length, so few places of a text are looked at.
    PART = regex.compile(r"\p{White_Space}{1000}|[^\p{White_Space}]{1000}")

    def __init__(self, data: bytes):
        self.own = Codec(data)
        ranks = {raw: i for raw, i in self.own.id_of.items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=self.own.special)
        self.bytes_of = self.own.bytes_of

    @staticmethod
    def proven(data: bytes) -> bool:
        own = Codec(data)
        for raw, i in own.id_of.items():
            for cut in range(1, len(raw)):
                a, b = own.id_of.get(raw[:cut]), own.id_of.get(raw[cut:])
                if a is not None and b is not None and (a, b) != (own.left.get(i), own.right.get(i)) and ((a, b) in own.joined or own.may_follow(a, b)):
                    return False
        words = {}
        for raw, i in own.id_of.items():
            try:
                words[raw.decode()] = i
            except UnicodeDecodeError:
                continue
        return all(own.packed[words[w]] == ids for w, ids in own.encode_words(set(words)).items())

    @classmethod
    def has_run(cls, text: str) -> bool:
        return any(cls.PART.match(text, at) for at in range(0, len(text) - 999, 1000)) and cls.RUN.search(text) is not None

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers."""
        out = []
        for text in texts:
            if self.has_run(text or ""):
                out += self.own.encode([text])
            else:
                out.append(self.fast.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False).tobytes())
        return out


def pack(doc_ids: list[int | None], arrays: list[bytes], frames: list[bytes], dictionary: bytes, item: int) -> bytes:
    n = len(doc_ids)
    return b"".join(
        [
            _HEAD.pack(MAGIC, item, hashlib.sha256(dictionary).digest(), n),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(a) // 4 for a in arrays], "<i8").tobytes(),
            np.cumsum([0, *map(len, frames)]).astype("<i8").tobytes(),
            *frames,
        ]
    )


class Shard:
    """Reader of one shard; ``ids(k)`` decompresses the k-th document alone."""

    def __init__(self, payload: bytes, dictionary: bytes):
        magic, self.item, digest, n = _HEAD.unpack_from(payload)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or written with another dictionary")
        at = _HEAD.size
        parts = []
        for kind, count in (("<i8", n), ("u1", n), ("<i8", n), ("<i8", n + 1)):
            parts.append(np.frombuffer(payload, kind, count, at))
            at += count * np.dtype(kind).itemsize
        ids, nulls, self.n_tokens, self.offsets = parts
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)]
        self.payload, self.base = memoryview(payload), at
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        frame = self.payload[self.base + self.offsets[k] : self.base + self.offsets[k + 1]]
        raw = self.reader.decompress(frame)
        return np.frombuffer(raw, "<u2" if self.item == 2 else "<u4").astype("<u4")


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 500, dictionary_size: int = 65_536, shard_bytes: int = 2 << 20, ranges: int | None = None) -> None:
    """Write ``folder``/dictionary and ``folder``/shards.

    Ranges are as many as ``RANGE_BYTES`` of text need, the session's shuffle partitions at least,
    or ``ranges``. Rows are dealt by (doc_id, hash of text), so rows that share an id or have none
    are dealt out too.
    """
    spark = documents.sparkSession
    shared = file_broadcast(spark, path)
    by_rank = ByRank.proven(shared.value)
    encoder = lambda: worker_state(broadcast_key("rank", shared), lambda: ByRank(shared.value)) if by_rank else codec(shared)
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def serial(encoded: list[bytes], item: int) -> list[bytes]:
        ids = [np.frombuffer(e, "<u4") for e in encoded]
        return [i.astype("<u2").tobytes() if item == 2 else i.tobytes() for i in ids]

    def of_sample(batches):
        own = encoder()
        end = end_id.to_bytes(4, "little")
        item = 2 if max(*own.bytes_of, end_id) < 1 << 16 else 4
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(serial([e + end for e in own.encode(batch.column("text").to_pylist())], item), pa.binary())], names=["ids"])

    rows = spread(source, sample_rows).mapInArrow(of_sample, "ids binary").collect()
    dictionary = train_dictionary([bytes(r[0]) for r in rows], dictionary_size)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = Shared(spark, dictionary)

    def of_range(batches):
        own, part = encoder(), None
        end = end_id.to_bytes(4, "little")
        item = 2 if max(*own.bytes_of, end_id) < 1 << 16 else 4
        writer = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(sent.value) if sent.value else None)
        ids, arrays, frames, held, made = [], [], [], 0, 0

        def shard():
            total = sum(len(a) // 4 for a in arrays)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([made], pa.int64()), pa.array([total], pa.int64()), pa.array([pack(ids, arrays, frames, sent.value, item)], pa.binary())], names=["range", "shard", "n_tokens", "payload"]
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                part = batch.column("range")[0].as_py()
                encoded = [e + end for e in own.encode(batch.column("text").to_pylist())]
                for d, e, raw in zip(batch.column("doc_id").to_pylist(), encoded, serial(encoded, item), strict=True):
                    frame = writer.compress(raw)
                    ids.append(d), arrays.append(e), frames.append(frame)
                    held += len(frame)
                    if held >= shard_bytes:
                        yield shard()
                        ids, arrays, frames, held, made = [], [], [], 0, made + 1
        if ids:
            yield shard()

    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(source.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // RANGE_BYTES))
    source = source.withColumn("deal", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("deal")]
    ordered = source.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    ordered.select(F.spark_partition_id().alias("range"), "doc_id", "text").mapInArrow(of_range, "range int, shard long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{folder}/shards")


def read_token_files(spark: SparkSession, folder: str, per_document: bool = True) -> DataFrame:
    """Rows of (doc_id, start, n_tokens, ids_crc32, ids) in the files: ``start`` counts the ids of
    all documents before. Totals of ranges, as many as there were ranges, meet at the driver."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    sent = Shared(spark, dictionary)
    shards = spark.read.parquet(f"{folder}/shards")
    base, bases = 0, []
    for r in sorted(shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["range"]):
        bases.append((r["range"], base))
        base += r["n"]
    within = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("range", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("within"))
    starts = starts.join(F.broadcast(spark.createDataFrame(bases, "range int, base long")), "range").select("range", "shard", (F.col("base") + F.col("within")).alias("start"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column("payload")[k].as_py(), sent.value)
                before = int(batch.column("start")[k].as_py())
                for at in range(0, len(shard.doc_ids), 256):
                    ids = [shard.ids(j) for j in range(at, min(at + 256, len(shard.doc_ids)))]
                    if any(len(i) != shard.n_tokens[at + j] for j, i in enumerate(ids)):
                        raise ValueError("a document's ids don't match the index")
                    n = np.array([len(i) for i in ids], np.int64)
                    first = before + np.cumsum(n) - n
                    before += int(n.sum())
                    columns = [pa.array(shard.doc_ids[at : at + 256], pa.int64()), pa.array(first), pa.array(n), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if not per_document:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = shards.select("range", "shard", "payload").join(starts, ["range", "shard"]).select("start", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if per_document else ", ids array<int>"))


def token_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}"
