"""Components and clusters: kernel components of distances, principal components, label propagation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.operators.distances import Distances, cdr3_matrix, kinds, of_members, usable, v_table
from bispace.session import work_table

COLUMNS = ["va", "cdr3a", "vb", "cdr3b"]


def receptor_matrix(table: Distances, a: list, b: list) -> np.ndarray:
    """Paired distances of receptors given as lists of (va, cdr3a, vb, cdr3b)."""
    x, y = (list(zip(*rows, strict=True)) for rows in (a, b))
    return sum(table.matrix(x[k], y[k]) + cdr3_matrix(x[k + 1], y[k + 1]) for k in (0, 2)).astype(np.float64)


def gram(d: np.ndarray, most: float, sdev: float | None) -> np.ndarray:
    """Similarities of distances: 1 - d / most, none below 0, or a Gaussian's."""
    return np.exp(-((d / sdev) ** 2)) if sdev else np.maximum(0.0, 1 - d / most)


def kernel_components(receptors: DataFrame, v: DataFrame, k: int = 50, landmarks: int = 2_000, most: float | None = None, sdev: float | None = None) -> DataFrame:
    """(id, kpc): ``k`` kernel principal components of paired distances.

    Up to ``landmarks`` receptors all of them take part, and the components are the exact ones. Beyond,
    that many, chosen by a hash of their id, give the components, and every receptor is projected on
    them (Nystroem), so cost grows with receptors times landmarks. ``most`` is the distance of no
    similarity, by default the landmarks' greatest; components of no weight are left out; signs make the
    largest entry positive. Equal receptors are projected once.
    """
    table = v_table(v)
    rows = usable(receptors).select("id", *COLUMNS)
    n = rows.count()
    chosen = rows if n <= landmarks else rows.withColumn("h", F.md5(F.col("id").cast("string"))).orderBy("h", "id").limit(landmarks)
    held = sorted(tuple(r[c] for c in ("id", *COLUMNS)) for r in chosen.select("id", *COLUMNS).collect())
    if not held:
        return rows.select("id", F.array().cast("array<double>").alias("kpc"))
    marks = [h[1:] for h in held]
    d = receptor_matrix(table, marks, marks)
    top = most or float(d.max()) or 1.0
    g = gram(d, top, sdev)
    mean, total = g.mean(0), g.mean()
    values, vectors = np.linalg.eigh(g - mean[:, None] - mean[None, :] + total)
    order = np.argsort(values)[::-1][:k]
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-9 * max(values[0], 1e-30)
    values, vectors = values[keep], vectors[:, keep]
    vectors *= np.sign(vectors[np.argmax(np.abs(vectors), 0), np.arange(vectors.shape[1])])
    project = vectors / np.sqrt(values)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = list(zip(*(part.column(c).to_pylist() for c in COLUMNS), strict=True))
                s = gram(receptor_matrix(table, own, marks), top, sdev)
                x = (s - s.mean(1, keepdims=True) - mean[None, :] + total) @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "kpc"])

    kind, members = kinds(rows)
    return of_members(work_table(kind.select("id", *COLUMNS).repartition(receptors.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "id long, kpc array<double>"), "projected"), members)


def principal_components(packed: DataFrame, width: int, k: int, scale: bool = False) -> DataFrame:
    """(id, x): the leading ``k`` components of packed features, by sums of products; standardised first
    with ``scale``. Signs make the largest loading positive."""

    def sums(batches):
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        v = np.concatenate([[n], s, ss.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["k", "v"])

    got = np.zeros(1 + width + width * width)
    for r in packed.select(F.col("x").cast("array<double>").alias("x")).mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r["k"]] = r["v"]
    n = max(got[0], 1)
    mean = got[1 : 1 + width] / n
    cov = got[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scale else np.ones(width)
    sd = np.where(sd > 1e-12, sd, 1.0)
    vectors = np.linalg.eigh(cov / np.outer(sd, sd))[1][:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.argmax(np.abs(vectors), 0), np.arange(vectors.shape[1])])
    loadings = vectors / sd[:, None]

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            y = (x - mean) @ loadings
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(y).ravel()))], names=["id", "x"])

    return packed.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(run, f"id {dict(packed.dtypes)['id']}, x array<double>")


def mixed_components(genes: DataFrame, n_genes: int, proteins: DataFrame, n_proteins: int, k_genes: int = 40, k_proteins: int = 20) -> DataFrame:
    """(id, x): components of genes beside those of standardised proteins."""
    a = principal_components(genes, n_genes, min(k_genes, n_genes))
    b = principal_components(proteins, n_proteins, min(k_proteins, n_proteins), True).withColumnRenamed("x", "y")
    return a.join(b, "id").select("id", F.concat("x", "y").alias("x"))


def label_clusters(edges: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, cluster) by label propagation on a neighbour graph, clusters numbered from 0 by size.

    Edges count both ways, mutual ones twice. In a round every node takes its neighbours' commonest
    label, its own counting half, ties to the smallest. Clusters by modularity are in ``modularity``.
    """
    # both ends of an edge from one row: a union would find the edges twice
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = work_table(edges.select(F.explode(ends).alias("e")).select("e.*"), "both")
    now = work_table(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = both.join(now.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "label", F.lit(1.0).alias("n"), F.lit(False).alias("own"))
        votes = votes.unionByName(now.select("id", "label", F.lit(0.5).alias("n"), F.lit(True).alias("own"))).groupBy("id", "label").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
        least = F.min_by("label", F.struct((-F.col("n")).alias("m"), "label")).alias("label")
        new = work_table(votes.groupBy("id").agg(least, F.max(F.when(F.col("own"), F.col("label"))).alias("old")), "labels")
        now = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            break
    sizes = now.groupBy("label").agg(F.count("*").alias("n"))
    from bispace.operators.windows import running_sum

    number = running_sum(sizes, [], [F.desc("n"), F.col("label")], F.lit(1), "k").select("label", (F.col("k") - 1).alias("cluster"))
    return now.join(number, "label").select("id", "cluster")
