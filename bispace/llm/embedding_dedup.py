"""Operator 7 - near-duplicate embeddings by an epsilon grid order join.

Unit vectors are laid out by the grid cells (side epsilon) of their leading principal coordinates,
sorted by cell, and cut into blocks of at most ``BLOCK`` vectors; ``SPAN`` blocks in order are an
interval. The join goes down the sequence: intervals whose boxes lie further apart than epsilon are
never joined, of the others only blocks that are near enough meet, and those are halved recursively,
again skipping halves that are provably distant. Cosines are computed in double precision from the
vectors as they are stored.

Epsilon is the chord of the cosine threshold; projecting never lengthens a distance, so no link is
lost. Exact copies are one vector with a multiplicity. A pair of blocks returns link counts and a
spanning forest of its links, never the pairs, so a group of thousands stays linear in memory.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label or vec_id, link with nothing and keep their own component; vectors of unlike
length are never linked; rows that repeat a vec_id with the same vector count as copies, with
another vector they are vectors of their own, each with its own links and component, and a component's
name is the smallest vec_id in it; an empty table gives an empty one; columns of other names are
ignored. Equal vectors are told by 128 bits of hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.operators.components import connected_components
from bispace.session import work_table

BLOCK, LEAF, DIMENSIONS, SPAN = 256, 64, 6, 64


def principal(vectors: DataFrame, size: int, k: int) -> np.ndarray:
    """Leading k principal directions of unit vectors of one length, as a (size, k) matrix.

    Tasks send sums of products; what reaches the driver has size**2 / 2 numbers for any table.
    """
    upper = np.triu_indices(size)

    def sums(batches):
        first, second = np.zeros(size), np.zeros((size, size))
        n = 0
        for batch in batches:
            x = unit(batch.column("v"))
            first += x.sum(0)
            second += x.T @ x
            n += len(x)
        values = np.concatenate([[n], first, second[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "x"])

    got = vectors.select("v").mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    values = np.zeros(1 + size + len(upper[0]))
    for r in got:
        values[r["i"]] = r["x"]
    n, mean = max(values[0], 1), values[1 : 1 + size] / max(values[0], 1)
    cov = np.zeros((size, size))
    cov[upper] = values[1 + size :] / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :k].copy()


def unit(lists) -> np.ndarray:
    """Rows of an Arrow list column of one length, as unit vectors in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1)
    return normal(x)


def normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distance(a: tuple, b: tuple) -> float:
    gap = np.maximum(np.maximum(b[0] - a[1], a[0] - b[1]), 0)
    return float(gap @ gap)


def joined(a: tuple, b: tuple, same: bool, cosine: float, reach: float):
    """Recursive join of two sequence intervals (unit vectors, coordinates): yields index arrays
    (i, j) of links, i < j if the intervals are the same."""
    stack = [(0, len(a[0]), 0, len(b[0]))]
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if same and j1 <= i0:
            continue
        boxes = [(y[p:q].min(0), y[p:q].max(0)) for (_, y), p, q in ((a, i0, i1), (b, j0, j1))]
        if _distance(*boxes) > reach:
            continue
        if max(i1 - i0, j1 - j0) <= LEAF:
            i, j = np.nonzero(a[0][i0:i1] @ b[0][j0:j1].T >= cosine)
            i, j = i + i0, j + j0
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        cut_i = [(i0, i1)] if i1 - i0 <= LEAF else [(i0, (i0 + i1) // 2), ((i0 + i1) // 2, i1)]
        cut_j = [(j0, j1)] if j1 - j0 <= LEAF else [(j0, (j0 + j1) // 2), ((j0 + j1) // 2, j1)]
        stack += [(*p, *q) for p in cut_i for q in cut_j]


def _forest(i: np.ndarray, j: np.ndarray, seen: dict) -> list[tuple[int, int]]:
    """Those of the links that join two trees of a growing forest."""

    def root(x):
        while seen.setdefault(x, x) != x:
            seen[x] = seen[seen[x]]
            x = seen[x]
        return x

    kept = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(p), root(q)
        if a != b:
            seen[max(a, b)] = min(a, b)
            kept.append((p, q))
    return kept


def _blocks(vectors: DataFrame, size: int, eps: float) -> DataFrame:
    """Vectors (label, id, copies, v) in grid order, cut into blocks with their boxes."""
    k = min(DIMENSIONS, size)
    axes = principal(vectors, size, k)

    def place(batches):
        for batch in batches:
            cells = np.floor(unit(batch.column("v")) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, c]) for c in range(k))], names=[*batch.schema.names, *(f"c{c}" for c in range(k))])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    placed = vectors.mapInArrow(place, fields + "".join(f", c{c} int" for c in range(k)))
    order = ["label", *(f"c{c}" for c in range(k)), "id"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "label", "id", "copies", "v")

    def cut(batches):
        made, label, ids, copies, rows = 0, None, [], [], []

        def block(part):
            x = np.stack(rows)
            y = normal(x.astype(np.float64)) @ axes
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + made], pa.int64()), pa.array([label], pa.string()),
                    pa.array([y.min(0).tolist()], pa.list_(pa.float64())), pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(copies, np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                ],
                names=["block", "label", "lo", "hi", "ids", "copies", "data"],
            )

        part = 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for l, i, n, row in zip(batch.column("label").to_pylist(), batch.column("id").to_pylist(), batch.column("copies").to_pylist(), x, strict=True):
                if rows and (l != label or len(rows) == BLOCK):
                    yield block(part)
                    made, ids, copies, rows = made + 1, [], [], []
                label = l
                ids.append(i), copies.append(n), rows.append(row)
        if rows:
            yield block(part)

    return work_table(placed.mapInArrow(cut, "block long, label string, lo array<double>, hi array<double>, ids binary, copies binary, data binary"), "grid"), axes


def _near(met: DataFrame, eps: float) -> DataFrame:
    """Rows whose two boxes (la, ha) and (lb, hb) are within epsilon."""
    gaps = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return met.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps * (1 + 1e-9))


def _pairs(blocks: DataFrame, eps: float, axes: int) -> DataFrame:
    """(a, b) of blocks of a label that may hold a link: near intervals first, then near blocks in them.

    Intervals meet by cells of the first axis; they are ``SPAN`` times fewer than blocks, and a pair of
    them gives no more than SPAN**2 pairs of blocks.
    """
    box = blocks.select("block", "label", "lo", "hi", F.concat_ws("/", "label", F.floor(F.col("block") / SPAN).cast("string")).alias("span"))
    side = lambda f, c: F.array(*[f(F.col(c)[k]) for k in range(axes)])
    spans = work_table(box.groupBy("span", "label").agg(side(F.min, "lo").alias("lo"), side(F.max, "hi").alias("hi")), "intervals")
    low, high = F.floor(F.col("lo")[0] / eps), F.floor(F.col("hi")[0] / eps)
    left = spans.select("label", F.col("span").alias("sa"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode(F.sequence(low, high)).alias("cell"))
    right = spans.select("label", F.col("span").alias("sb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode(F.sequence(low - 1, high + 1)).alias("cell"))
    near = _near(left.join(right, ["label", "cell"]), eps).select("sa", "sb").distinct()
    sides = [box.select(F.col("span").alias(f"s{x}"), F.col("block").alias(x), F.col("lo").alias(f"l{x}"), F.col("hi").alias(f"h{x}")) for x in "ab"]
    return _near(near.join(sides[0], "sa").join(sides[1], "sb").where("a <= b"), eps).select("a", "b")


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = embeddings.sparkSession
    eps = math.sqrt(2 - 2 * cosine) + 1e-9
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), F.col(label).cast("string").alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ok = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    rows = rows.withColumn("v", F.when(ok, F.col("v")))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    same = ["label", "h1", "h2"]
    found = rows.where("v is not null").groupBy(*same).agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("copies"))
    groups = work_table(found.withColumn("id", F.monotonically_increasing_id()), "vectors")  # a vector's number
    counts = edges = None
    for (size,) in groups.select(F.size("v").alias("n")).distinct().orderBy("n").collect():
        blocks, axes = _blocks(groups.where(F.size("v") == size).select("label", "v", "id", "copies"), size, eps)
        kind = np.float32 if dict(groups.dtypes)["v"] == "array<float>" else np.float64
        names = ["block", "ids", "copies", "data"]
        both = _pairs(blocks, eps, axes.shape[1])
        for side in "ab":
            both = both.join(blocks.select(*(F.col(c).alias(c + side) for c in names)), F.col(side) == F.col("block" + side))
        both = both.select("a", "b", *(c + side for side in "ab" for c in names[1:]))

        def run(batches, axes=axes, kind=kind, size=size):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    side = []
                    for s in "ab":
                        x = normal(np.frombuffer(row["data" + s], kind).astype(np.float64).reshape(-1, size))
                        side.append((np.frombuffer(row["ids" + s], np.int64), np.frombuffer(row["copies" + s], np.int64), x, x @ axes))
                    (ia, ca, xa, ya), (ib, cb, xb, yb) = side
                    same, na, nb, tree, links = row["a"] == row["b"], np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), {}, []
                    for i, j in joined((xa, ya), (xb, yb), same, cosine, eps * eps):
                        np.add.at(na, i, cb[j])
                        np.add.at(nb, j, ca[i])
                        links += [(ia[p], ib[q if same else q - len(ia)]) for p, q in _forest(i, j if same else j + len(ia), tree)]
                    ids = np.concatenate([ia[na > 0], ib[nb > 0], [p for p, _ in links]]).astype(np.int64)
                    n = np.concatenate([na[na > 0], nb[nb > 0], np.zeros(len(links))]).astype(np.int64)
                    to = [None] * int((na > 0).sum() + (nb > 0).sum()) + [int(q) for _, q in links]
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(to, pa.int64())], names=["id", "n", "to"])

        found = work_table(both.mapInArrow(run, "id long, n long, to long"), "joined")  # batches are bounded by bytes
        n, e = found.where("to is null").groupBy("id").agg(F.sum("n").alias("n")), found.where("to is not null").select("id", "to")
        counts, edges = (n, e) if counts is None else (counts.unionByName(n), edges.unionByName(e))
    if counts is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    classes = connected_components(edges, "id", "to").withColumnRenamed("node", "id")
    of_group = groups.drop("v").join(counts.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(classes, "id", "left").withColumn("class", F.coalesce("component", "id"))
    name = of_group.groupBy("class").agg(F.min("least").alias("component_id"))
    of_group = of_group.join(name, "class").select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    done = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.col("h1"))).drop("v").join(of_group, same, "left")
    own = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
