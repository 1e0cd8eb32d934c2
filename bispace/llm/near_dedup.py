"""Operator 2 - near-duplicate documents by consistent weighted sampling.

Shingles of five words weigh their count in the text times a damped inverse document frequency,
``1 + ln(N / df) / ln(N + 1)`` (1 to 2). Document frequencies cover all documents; they are counted
in a table of ``2**DF_BITS`` hashed counters, so the table has the same size for any corpus. The
median counter, what rare shingles that fall together make of any counter in a large corpus, is taken
off, so that frequent shingles still stand out there; the rare ones then all weigh alike.

Every occurrence of a shingle is a unit of its own, of the same weight in any text, so the units of
two texts have the texts' weighted Jaccard similarity. Units arrive in ``BINS`` bins as Poisson
processes whose rates are their weights; the first arrival of a bin is its draw. By the splitting
of such processes these are ``BINS`` independent draws over all units in proportion to weight, while
only arrivals that can still be the first of a bin are computed. Draws are banded (``BANDS`` x ``ROWS``).

Candidates are met without pairs of all members: exact copies are one text; each text
is compared with the smallest ids of the buckets that it shares most with; and where members of a
bucket still belong to different classes, the rest of their comparisons is made exactly in two
rounds, within blocks of members and then between blocks, between classes only. A round gives a
spanning forest of what two blocks link, never their pairs.
A candidate is a link if its weighted Jaccard similarity, computed from whole texts, is at least
``similarity``. Classes are connected components, found without collecting them.

Defined cases: a text without words (null, empty) is alike to nothing and keeps its own class;
texts of fewer than five words are one shingle; rows that repeat a doc_id and its text are one
document; rows that repeat a doc_id with another text are compared as documents of their own, and a
class is named by its smallest doc_id that has all its rows in it, if there is one; a row
of a null doc_id isn't compared, it gets the class of its text if another row has it, else null, and is
kept; an empty table gives an empty one. Only doc_id and text are
read; columns of any other name don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import Shared, broadcast_key, mix64, release, shingle_hashes, tidy, word_hashes, worker_state
from bispace.operators.components import connected_components
from bispace.session import work_table

BINS, BANDS, ROWS, DF_BITS, CHUNK, BLOCK, BLOCK_BYTES = 64, 16, 4, 20, 1 << 14, 256, 2 << 20
SHINGLE = 5
#: Pairs of one lead that a task gets.
PAIRS_TOGETHER = 256


def counted_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct shingles of a whole text, their counts, and a key of its sequence of words."""
    words = word_hashes(text)
    found, n = np.unique(shingle_hashes(words, SHINGLE), return_counts=True)
    return found, n, hashlib.blake2b(words.tobytes(), digest_size=16).digest()


class Weights:
    """Weights of shingles from the hashed document frequencies of N documents."""

    def __init__(self, df: np.ndarray, documents: int):
        df = df.astype(np.float64) - np.median(df)
        self.idf = (1 + np.log(max(documents, 1) / np.clip(df, 1, max(documents, 1))) / np.log(documents + 2)).astype(np.float64)

    def of(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * self.idf[(shingles >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def units(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for each occurrence of each shingle, the k-th alike in any text."""
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    with np.errstate(over="ignore"):
        return mix64(np.repeat(shingles, counts) + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sample(shingles: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Consistent weighted draws of many texts at once: (texts, BINS) of 32 bits.

    Every unit has its own sequence of arrival times and bins; the earliest arrival of a bin wins.
    A unit is followed until its arrivals are later than the first ones of all bins of its text.
    """
    first, winner = np.full(texts * BINS, np.inf), np.zeros(texts * BINS, np.int64)
    unit, x, time, limit = np.arange(len(shingles)), shingles, np.zeros(len(shingles)), np.zeros(texts)
    while len(unit):
        with np.errstate(over="ignore"):
            x = mix64(x + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / weights
        place = owner * BINS + (x & np.uint64(BINS - 1)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        winner[place[won]] = unit[won]
        live = np.flatnonzero(np.bincount(owner, minlength=texts))
        limit[live] = first.reshape(texts, BINS)[live].max(1)
        on = np.flatnonzero(time < limit[owner])
        unit, x, time, weights, owner = unit[on], x[on], time[on], weights[on], owner[on]
    draws = (mix64(shingles) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return np.where(np.isfinite(first), draws[winner] if len(draws) else np.uint32(0), np.uint32(0)).reshape(texts, BINS)


def bands(draws: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket numbers; a bucket number holds its band."""
    rows = draws.astype(np.uint64).reshape(len(draws), BANDS, ROWS)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            acc = mix64(acc * np.uint64(0x9FB21C651E98DF25) + rows[:, :, k] + np.uint64(1))
    return acc.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller weights over sum of larger ones; shingles are sorted."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][at], b[1][bt]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total > 0 else 0.0


def _frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of all documents: a table of fixed size reaches the driver."""

    def count(batches):
        release()
        df, n = np.zeros(1 << DF_BITS, np.uint32), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [np.unique(shingle_hashes(word_hashes(t), SHINGLE)) for t in batch.column("text").to_pylist()]
                n += len(found)
                places = (np.concatenate(found) >> np.uint64(64 - DF_BITS)).astype(np.int64)
                df += np.bincount(places, minlength=1 << DF_BITS).astype(np.uint32)
        yield from _chunks(df, n)

    def _chunks(df, n):
        used = [k for k in range(0, len(df), CHUNK) if df[k : k + CHUNK].any()] if n else []
        kept = [df[k : k + CHUNK] for k in used]
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int64()), pa.array([*(c.tobytes() for c in kept), np.array([n], np.uint32).tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(keys, table):
        total = 0
        for c in table.column("counts").to_pylist():
            total = np.frombuffer(c, np.uint32).astype(np.int64) + total
        packed = np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()
        return pa.table({"chunk": pa.array([keys[0].as_py()], pa.int64()), "counts": pa.array([packed], pa.binary())})

    counted = documents.mapInArrow(tidy(count), "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    df, n = np.zeros(1 << DF_BITS, np.uint32), 0
    for r in counted:
        values = np.frombuffer(bytes(r["counts"]), np.uint32)
        if r["chunk"] < 0:
            n = int(values[0])
        else:
            df[r["chunk"] : r["chunk"] + len(values)] = values
    return df, n


def _signatures(documents: DataFrame, weights) -> DataFrame:
    """(doc_id, hash, key, draws, buckets, size) of every document; no words: null key."""

    def run(batches):
        own = worker_state(broadcast_key("weights", weights), lambda: Weights(*weights.value))
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = [counted_shingles(t) for t in batch.column("text").to_pylist()]
                sizes = np.array([f[1].sum() for f in found])
                shingles, n = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                weight = np.repeat(own.of(shingles, np.ones(len(n))), n)
                draws = sample(units(shingles, n), weight, np.repeat(np.arange(len(found)), sizes), len(found))
                bucket = bands(draws)
                has = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("hash"),
                        pa.array([f[2] if h else None for f, h in zip(found, has, strict=True)], pa.binary()),
                        pa.array([d.tobytes() if h else None for d, h in zip(draws, has, strict=True)], pa.binary()),
                        pa.array([b.tolist() if h else None for b, h in zip(bucket, has, strict=True)], pa.list_(pa.int64())),
                        pa.array([len(t or "") for t in batch.column("text").to_pylist()], pa.int64()),
                    ],
                    names=["doc_id", "hash", "key", "draws", "buckets", "size"],
                )

    return documents.mapInArrow(tidy(run), "doc_id long, hash long, key binary, draws binary, buckets array<long>, size long")


def _texts(documents: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of some of the distinct texts (rep): a text is fetched from one row that has it."""
    wanted = reps.join(ids.select("rep").distinct(), "rep").select("rep", "at.doc_id", "at.hash")
    return documents.join(wanted, ["doc_id", "hash"]).groupBy("rep").agg(F.first("text").alias("text"))


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b, parts) with a column of ``table`` (rep, column) for a. A lead with many pairs is met
    in as many parts as its pairs say."""
    most = pairs.groupBy("a").agg(F.max("parts").alias("most"))
    dealt = table.select(F.col("rep").alias("a"), column).join(most, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).drop("most")
    return pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(dealt, ["a", "part"]).drop("part")


def _verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame, weights, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, parts) whose whole texts are alike."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
    texts = _texts(documents, reps, ids)

    def run(batches):
        own = worker_state(broadcast_key("weights", weights), lambda: Weights(*weights.value))
        last: tuple = (None, None)

        def of(text):
            shingles, n, _ = counted_shingles(text)
            return shingles, own.of(shingles, n)

        for batch in batches:
            links = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if last[0] != a:
                    last = (a, of(ta))
                links.append(weighted_jaccard(last[1], of(tb)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(links, pa.bool_())], names=["a", "b", "link"])

    both = _beside(pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b"), texts, "text").withColumnRenamed("text", "ta")
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long, link boolean").where("link").select("a", "b")


def _alike(a: str, b: str):
    """Number of equal draws of two packed signatures, on the JVM side."""
    part = lambda c, k: F.substring(c, 1 + 4 * k, 4)
    return sum((F.when(part(a, k) == part(b, k), 1).otherwise(0) for k in range(BINS)), F.lit(0))


def _blocks(members: DataFrame, classes: DataFrame, draws: DataFrame, apart: bool) -> DataFrame:
    """(block, bucket, band, side, m) of buckets whose members still belong to several classes.

    Members are cut at random into blocks of about ``BLOCK`` texts and ``BLOCK_BYTES`` bytes, so a
    large bucket is many small rows. ``apart`` puts a bucket's largest class (side 1) into blocks
    of its own, which needn't meet each other.
    """
    own = members.join(classes, members["rep"] == classes["node"], "left").select("bucket", "band", "rep", "size", F.coalesce("component", "rep").alias("class"))
    sizes = own.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "class", "bytes")).alias("top")).where("k > 1")
    at = own.join(mixed.select("bucket", "n", "bytes", "top"), "bucket").withColumn("side", ((F.col("class") == F.col("top.class")) & F.lit(apart)).cast("int"))
    held = [F.when(F.col("side") == 1, F.col(f"top.{c}")).otherwise(F.col(c) - (F.col(f"top.{c}") if apart else 0)) / most for c, most in (("n", BLOCK), ("bytes", BLOCK_BYTES))]
    at = at.select("bucket", "band", "rep", "class", "side", F.pmod(F.xxhash64("rep"), F.ceil(F.greatest(*held, F.lit(1)))).alias("part")).join(draws, "rep")
    met = at.groupBy("bucket", "band", "side", "part").agg(F.collect_list(F.struct("rep", "class", "draws")).alias("m"))
    return work_table(met.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _met(blocks: DataFrame, least: int, apart: bool) -> DataFrame:
    """(blocka, blockb, pairs): for two blocks of a bucket, the pairs of members of different classes that could be alike.

    ``pairs`` packs places in the two blocks. A pair belongs to the first band in which its draws
    agree, so it is met in one bucket only. Without ``apart`` blocks meet just themselves.
    """
    sides = [blocks.select("bucket", "band", F.col("block").alias("block" + x), F.col("side").alias("side" + x), F.col("m").alias("m" + x)) for x in "ab"]
    if apart:
        ids = sides[0].select("bucket", "blocka", "sidea").join(sides[1].select("bucket", "blockb", "sideb"), "bucket").where("blocka <= blockb and not (sidea = 1 and sideb = 1)")
        met = ids.select("blocka", "blockb").join(sides[0].select("band", "blocka", "ma"), "blocka").join(sides[1].select("blockb", "mb"), "blockb")
    else:
        met = sides[0].select("band", "blocka", F.col("blocka").alias("blockb"), "ma", F.lit(None).cast(blocks.schema["m"].dataType).alias("mb"))

    def unpack(m):
        return np.frombuffer(b"".join(x["draws"] for x in m), np.uint32).reshape(len(m), BINS), np.array([x["class"] for x in m])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                band, x, y, ma, mb = (batch.column(c)[k].as_py() for c in ("band", "blocka", "blockb", "ma", "mb"))
                (da, ca), (db, cb) = unpack(ma), unpack(ma if x == y else mb)
                out = []
                for i, row in enumerate(da):
                    away = cb != ca[i]
                    away[: i + 1 if x == y else 0] = False
                    js = np.flatnonzero(away)
                    same = db[js] == row
                    enough = same.sum(1) >= least
                    js = js[enough][same[enough].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
                    out.append(np.stack([np.full(len(js), i), js], 1))
                pairs = np.concatenate(out).astype(np.uint16)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([y], pa.int64()), pa.array([pairs.tobytes()], pa.binary())], names=["blocka", "blockb", "pairs"])

    return work_table(met.select("band", "blocka", "blockb", "ma", "mb").mapInArrow(tidy(run), "blocka long, blockb long, pairs binary"), "met")


def _links_between(met: DataFrame, blocks: DataFrame, documents: DataFrame, reps: DataFrame, weights, similarity: float) -> DataFrame:
    """Links (a, b) of alike pairs of ``met``: of two blocks, a spanning forest of their classes.

    Pairs that other links of the same blocks have joined already aren't compared, since they
    can't change a class; so a large group gives links in proportion to its members.
    """
    ids = met.select(F.col("blocka").alias("block")).unionByName(met.select(F.col("blockb").alias("block"))).distinct()
    inside = blocks.join(ids, "block").select("block", F.posexplode("m").alias("at", "x")).select("block", "at", "x.rep", "x.class")
    filled = work_table(inside.join(_texts(documents, reps, inside), "rep").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "rep", "class", "text"))).alias("m")), "filled")
    both = met.join(filled.select(F.col("block").alias("blocka"), F.col("m").alias("ma")), "blocka").join(filled.select(F.col("block").alias("blockb"), F.col("m").alias("mb")), "blockb")

    def run(batches):
        own = worker_state(broadcast_key("weights", weights), lambda: Weights(*weights.value))

        def weighed(held, m, k):
            if k not in held:
                shingles, n, _ = counted_shingles(m[k]["text"])
                held[k] = shingles, own.of(shingles, n)
            return held[k]

        for batch in batches:
            for k in range(batch.num_rows):
                ma, mb = batch.column("ma")[k].as_py(), batch.column("mb")[k].as_py()
                heads: dict = {}

                def head(c, heads=heads):
                    while heads.get(c, c) != c:
                        c = heads[c]
                    return c

                ha, hb, links = {}, {}, []
                for i, j in np.frombuffer(batch.column("pairs")[k].as_py(), np.uint16).reshape(-1, 2).tolist():
                    x, y = head(ma[i]["class"]), head(mb[j]["class"])
                    if x != y and weighted_jaccard(weighed(ha, ma, i), weighed(hb, mb, j)) >= similarity:
                        heads[max(x, y)] = min(x, y)
                        links.append((ma[i]["rep"], mb[j]["rep"]))
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.select("pairs", "ma", "mb").mapInArrow(tidy(run), "a long, b long")


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = 0.8, by_row: bool = False) -> DataFrame:
    """(doc_id, class_id, kept): class_id is the smallest doc_id of a class, which is kept.

    With ``by_row`` rows are told by id and text: ``text_hash`` (xxhash64 of the text) comes along, and
    ``kept`` holds for one text of one id in each class, the first by (doc_id, text_hash) under its name.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    weights = Shared(spark, _frequencies(source.select("text")))
    signed = work_table(_signatures(source, weights), "signatures")
    known = signed.where("key is not null and doc_id is not null")
    reps = known.groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("at"), F.first("draws").alias("draws"), F.first("buckets").alias("buckets"), F.first("size").alias("size"))
    reps = work_table(reps.withColumn("rep", F.monotonically_increasing_id()), "texts")  # a text's number
    members = reps.select("rep", "size", F.posexplode("buckets").alias("band", "bucket"))
    leads = members.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    shared = work_table(members.join(leads, "bucket"), "buckets")
    draws = reps.select("rep", "draws")
    least = int(BINS * (similarity - 0.3))  # six deviations of 64 independent draws below
    # first each text with the two leads that share most of its buckets; what that leaves is met in blocks
    pairs = shared.where("rep <> lead").groupBy("rep", "lead").agg(F.count("*").alias("n"), F.ceil(F.max("n") / PAIRS_TOGETHER).cast("int").alias("parts"))
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("n"), "lead"))
    pairs = pairs.withColumn("r", best).where("r <= 2").select(F.col("lead").alias("a"), F.col("rep").alias("b"), "parts")
    near = _beside(pairs.join(draws.select(F.col("rep").alias("b"), F.col("draws").alias("db")), "b"), draws, "draws")
    near = work_table(near.where(_alike("draws", "db") >= least).select("a", "b", "parts"), "pairs")
    links = work_table(_verified(near, source, reps, weights, similarity), "links")
    classes = connected_components(links, "a", "b")
    for apart in (False, True):  # within blocks first: it leaves few classes for the blocks to meet over
        blocks = _blocks(shared.select("bucket", "band", "rep", "size"), classes, draws, apart)
        met = _met(blocks, least, apart)
        if not met.isEmpty():
            links = work_table(links.unionByName(_links_between(met, blocks, source, reps, weights, similarity)), "links")
            classes = connected_components(links, "a", "b")
    of_text = reps.select("key", "rep").join(classes, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("class"))
    rows = signed.select("doc_id", "hash", "key").join(of_text, "key", "left")
    # a class takes its name from an id that it has to itself, rather than from one with several texts
    ids = rows.where("class is not null and doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("class"), F.max("class").alias("other"))
    split = ids.where("class <> other").select("doc_id", F.lit(True).alias("split"))
    held = rows.where("class is not null and doc_id is not null").join(split, "doc_id", "left")
    name = held.groupBy("class").agg(F.min(F.struct(F.coalesce("split", F.lit(False)).alias("split"), "doc_id", "hash")).alias("name"))
    name = name.select("class", F.col("name.doc_id").alias("class_id"), F.col("name.hash").alias("class_hash"))
    done = rows.join(name, "class", "left")
    if by_row:
        own = (F.col("doc_id") == F.col("class_id")) & (F.col("hash") == F.col("class_hash"))
        return done.select("doc_id", F.col("hash").alias("text_hash"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(own, F.lit(True)).alias("kept"))
    done = done.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
