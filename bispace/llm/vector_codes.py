"""Operator 13 - product codes of vectors by Lloyd's rounds with the filtering algorithm.

Components become integers, a vector is cut into equal parts, and each part position has a codebook.
Every partition cuts its vectors into blocks and builds, once, a kd-tree per part position over a
block: nodes hold a bounding box, the sum of their parts and their number. A round sends the small
codebooks to the blocks; a node keeps only entries that may be nearest to some point of its box, and
a node with one entry left gives its cached sum and count to it without a look at its points. What
leaves a task are sums by position, entry and component; all arithmetic is in whole numbers, so the
result doesn't depend on blocks, partitions or the order of rows.

A box keeps entry z beside the entry s nearest to its middle unless, at the corner of the box that
favours z most, z is farther than s, or as far with a higher index.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped;
the length of the vectors is that of the first row in order of (vec_id, vector), null ids last; a
vector of another length, or with a component too large for exact sums of squares in 64 bits, stays
with null ``code`` and ``error`` and shapes no codebook; a length that ``parts`` doesn't divide is
filled up with zeros; fewer rows than entries make smaller codebooks; rows that repeat an id are
coded one by one; null labels share one sum; an empty table gives an empty one; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.session import work_table

BLOCK, LEAF = 4096, 32


@lru_cache(maxsize=64)
def shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, left child or -1) of the nodes of a tree over n points; the right child follows."""
    start, end, left, k = [0], [n], [], 0
    while k < len(start):
        s, e = start[k], end[k]
        if e - s > LEAF:
            left.append(len(start))
            start += [s, (s + e) // 2]
            end += [(s + e) // 2, e]
        else:
            left.append(-1)
        k += 1
    return np.array(start), np.array(end), np.array(left)


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kd-tree of points: their order, and lowest, highest and summed components by node."""
    start, end, left = shape(len(x))
    order = np.arange(len(x), dtype=np.int32)
    lo, hi, total = (np.zeros((len(start), x.shape[1]), kind) for kind in (np.int32, np.int32, np.int64))
    for k in range(len(start)):
        own = order[start[k] : end[k]]
        y = x[own]
        lo[k], hi[k], total[k] = y.min(0), y.max(0), y.sum(0, dtype=np.int64)
        if left[k] >= 0:
            axis = int(np.argmax(hi[k].astype(np.int64) - lo[k]))
            order[start[k] : end[k]] = own[np.argpartition(y[:, axis], end[left[k]] - start[k])]
    return order, lo, hi, total


def filtered(n: int, lo: np.ndarray, hi: np.ndarray, book: np.ndarray):
    """Walk of a tree with a codebook: (nodes, entries) that belong together whole, and the leaves
    that keep several entries."""
    _, _, left = shape(n)
    nodes, live = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    whole_nodes, whole_entries, mixed = [], [], []
    index = np.arange(len(book))
    far = np.iinfo(np.int64).max
    while len(nodes):
        a, b = lo[nodes].astype(np.int64), hi[nodes].astype(np.int64)
        middle = np.where(live, ((2 * book - (a + b)[:, None]) ** 2).sum(2), far)
        best = middle.argmin(1)
        star = book[best][:, None]
        corner = np.where(book[None] > star, b[:, None], a[:, None])
        own, others = ((book - corner) ** 2).sum(2), ((star - corner) ** 2).sum(2)
        live &= (own < others) | ((own == others) & (index <= best[:, None]))
        one = live.sum(1) == 1
        whole_nodes.append(nodes[one])
        whole_entries.append(best[one])
        leaf = ~one & (left[nodes] < 0)
        mixed.append(nodes[leaf])
        down = ~one & ~leaf
        nodes = np.repeat(left[nodes[down]], 2) + np.tile([0, 1], int(down.sum()))
        live = np.repeat(live[down], 2, axis=0)
    return np.concatenate(whole_nodes), np.concatenate(whole_entries), np.concatenate(mixed)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after another."""
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point, the lower index of equals, and the squared distance."""
    d = ((x[:, None].astype(np.int64) - book) ** 2).sum(2)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def gathered(x: np.ndarray, tree: tuple, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points by their nearest entry."""
    order, lo, hi, total = tree
    start, end, _ = shape(len(x))
    nodes, entries, mixed = filtered(len(x), lo, hi, book)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    np.add.at(sums, entries, total[nodes])
    np.add.at(counts, entries, (end - start)[nodes])
    if len(mixed):
        rest = x[order[_ranges(start[mixed], end[mixed])]].astype(np.int64)
        at, _ = nearest(rest, book)
        np.add.at(sums, at, rest)
        np.add.at(counts, at, 1)
    return sums, counts


def assigned(x: np.ndarray, tree: tuple, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each point."""
    order, lo, hi, _ = tree
    start, end, _ = shape(len(x))
    nodes, entries, mixed = filtered(len(x), lo, hi, book)
    at = np.zeros(len(x), np.int64)
    at[order[_ranges(start[nodes], end[nodes])]] = np.repeat(entries, (end - start)[nodes])
    if len(mixed):
        rest = order[_ranges(start[mixed], end[mixed])]
        at[rest], _ = nearest(x[rest], book)
    return at, ((x.astype(np.int64) - book[at]) ** 2).sum(1)


class _Block:
    """Vectors of a block and the trees over their parts, as packed columns of one row."""

    NAMES = ["n", "data", "orders", "lows", "highs", "sums"]
    FIELDS = "n int, data binary, orders binary, lows binary, highs binary, sums binary"

    @staticmethod
    def packed(x: np.ndarray, parts: int) -> list[pa.Array]:
        x = x.reshape(len(x), parts, -1)
        trees = [build(x[:, p]) for p in range(parts)]
        return [pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary()), *(pa.array([b"".join(t[k].tobytes() for t in trees)], pa.binary()) for k in range(4))]

    def __init__(self, batch: pa.RecordBatch, row: int, parts: int, size: int):
        n, data, *trees = (batch.column(c)[row].as_py() for c in self.NAMES)
        nodes = len(shape(n)[0])
        self.x = np.frombuffer(data, np.int32).reshape(n, parts, size // parts)
        forms = ((np.int32, (n,)), (np.int32, (nodes, size // parts)), (np.int32, (nodes, size // parts)), (np.int64, (nodes, size // parts)))
        held = [np.frombuffer(raw, kind).reshape(parts, *form) for raw, (kind, form) in zip(trees, forms, strict=True)]
        self.trees = list(zip(*held, strict=True))


def quantized(v, scale: int = 4096) -> np.ndarray:
    """Rows of an Arrow list column of one length as floor(scale * x), filled up by the caller."""
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(v), -1)


def vector_codes(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code, error, label_error), and the codebook (entries x components) of each part."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    spark = embeddings.sparkSession
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v")).where(F.coalesce(fine, F.lit(False)))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return rows.select(F.col("id").alias("vec_id"), "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    length = len(first[0]["v"])
    size = -(-length // parts) * parts
    most = math.isqrt((1 << 62) // size) // 4
    codable = (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) <= most / scale - 1)
    seeds = rows.where(codable).where("id is not null").orderBy(*order).limit(entries).collect()  # entries rows at most
    seeds = seeds or rows.where(codable).orderBy(*order).limit(entries).collect()

    def fill(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, size - x.shape[1]))).astype(np.int32)

    def build_blocks(batches):
        held, n = [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole.column(c).chunk(0)) for c in ("id", "label")]
            v = whole.column("v").chunk(0)
            return pa.RecordBatch.from_arrays([*lists, *_Block.packed(fill(quantized(v, scale)), parts)], names=["ids", "labels", *_Block.NAMES])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = batch.slice(at, BLOCK - n)
                held.append(take)
                n, at = n + take.num_rows, at + take.num_rows
                if n == BLOCK:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    blocks = work_table(rows.where(codable).mapInArrow(build_blocks, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, {_Block.FIELDS}"), "kd-trees")
    books = fill(quantized(pa.array([list(r["v"]) for r in seeds], pa.list_(pa.float64())), scale)).astype(np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2) if seeds else np.zeros((parts, 0, size // parts), np.int64)
    for _ in range(rounds if seeds else 0):

        def sums(batches, books=books):
            total, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for k in range(batch.num_rows):
                    own = _Block(batch, k, parts, size)
                    for p in range(parts):
                        s, c = gathered(own.x[:, p], own.trees[p], books[p])
                        total[p] += s
                        counts[p] += c
            values = np.concatenate([counts[..., None], total], 2).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "x"])

        got = blocks.select(*_Block.NAMES).mapInArrow(sums, "cell long, x long").groupBy("cell").agg(F.sum("x").alias("x")).collect()  # parts x entries x components
        values = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
        for r in got:
            values[r["cell"]] = r["x"]
        values = values.reshape(*books.shape[:2], -1)
        counts = values[..., :1]
        books = np.where(counts > 0, values[..., 1:] // np.maximum(counts, 1), books)

    def codes(batches):
        digits = [f"{k:02x}" for k in range(256)]
        for batch in batches:
            for k in range(batch.num_rows):
                own = _Block(batch, k, parts, size)
                done = [assigned(own.x[:, p], own.trees[p], books[p]) for p in range(parts)]
                code = ["".join([digits[e] for e in row]) for row in np.stack([d[0] for d in done], 1).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(code), pa.array(sum(d[1] for d in done))], names=["id", "label", "code", "error"]
                )

    coded = blocks.mapInArrow(codes, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    rest = rows.where(~codable).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = work_table(coded.unionByName(rest).withColumn("slice", F.spark_partition_id()), "codes")
    # a label's rows are summed where they lie, so a label with a third of all rows is one row a slice
    partial = coded.groupBy("slice", "label").agg(F.sum("error").alias("error"))
    whole = partial.groupBy("label").agg(F.sum("error").alias("label_error"))
    here, there = partial.select("slice", F.col("label").alias("l")), whole.withColumnRenamed("label", "m")
    named = here.join(there, F.col("l").eqNullSafe(F.col("m"))).select(F.col("slice").alias("s"), "l", "label_error")
    done = coded.join(named, (F.col("slice") == F.col("s")) & F.col("label").eqNullSafe(F.col("l")))
    return done.select(F.col("id").alias("vec_id"), "label", "code", "error", "label_error"), [books[p] for p in range(parts)]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
