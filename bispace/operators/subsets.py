"""Filters of cells and clones, splits into subsets, and filters of ranked and redundant features."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions.scores import is_invariant

#: What markers of helper and killer cells are scaled by before they are compared.
CD4_SCALE, CD8_SCALE = 1 / 0.6, 1 / 2.0


def by_feature_type(features: DataFrame, keep: str) -> DataFrame:
    return features.where(F.col("feature_type") == keep)


def without_v_genes(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Rows neither of whose V genes holds one of the strings; a null V gene holds none."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.coalesce(F.col("va").contains(p), F.lit(False)) | F.coalesce(F.col("vb").contains(p), F.lit(False))
    return rows.where(~bad)


def without_invariant(rows: DataFrame, organism: str) -> DataFrame:
    """Rows that are neither MAIT nor iNKT; known for people and mice only."""
    if organism not in ("human", "mouse"):
        raise ValueError(f"no invariant rules for {organism}")
    return rows.where(~F.coalesce(is_invariant(F.col("va"), F.col("ja"), F.col("cdr3a"), F.col("vb"), organism), F.lit(False)))


def without_barcodes(rows: DataFrame, bad: DataFrame, column: str = "barcode") -> DataFrame:
    """Rows whose barcode isn't listed in ``bad`` (barcode); a null barcode is never listed."""
    return rows.join(bad.select(F.col("barcode").alias(column)).distinct(), column, "left_anti")


def without_clusters(rows: DataFrame, cluster: str, bad: list) -> DataFrame:
    """Rows of other clusters; those without a cluster stay."""
    return rows.where(~F.coalesce(F.col(cluster).isin(*bad), F.lit(False)))


def at_least(rows: DataFrame, least: int, what: str) -> DataFrame:
    """``rows``, or an error if they are fewer than ``least``; no more than that many are counted."""
    if rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} {what}")
    return rows


def cluster_markers(cells: DataFrame, cluster: str, cd4: list[str], cd8: list[str], protein: bool = False) -> DataFrame:
    """(cluster, n, cd4, cd8): scaled means of marker columns; proteins aren't scaled, missing columns are 0."""
    mean = lambda names: sum((F.col(c) if c in cells.columns else F.lit(0.0) for c in names), F.lit(0.0)) / len(names)
    s4, s8 = (1.0, 1.0) if protein else (CD4_SCALE, CD8_SCALE)
    return cells.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), (F.avg(mean(cd4)) * s4).alias("cd4"), (F.avg(mean(cd8)) * s8).alias("cd8"))


def marker_subset(cells: DataFrame, cluster: str, which: str, cd4: list[str], cd8: list[str], protein: bool = False) -> DataFrame:
    """Cells of clusters whose markers are strictly higher for CD4 or CD8."""
    m = cluster_markers(cells, cluster, cd4, cd8, protein).where("cd4 > cd8" if which == "CD4" else "cd8 > cd4")
    return cells.join(m.select(F.col("cluster").alias(cluster)), cluster, "left_semi")


def with_clusters(cells: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``cells`` with ``cluster``, by modularity of a neighbour graph (src, dst) over their ids."""
    from bispace.operators.modularity import modularity_clusters

    return cells.drop("cluster").join(modularity_clusters(edges, cells.select("id"), resolution=resolution), "id")


def marker_tags(cells: DataFrame, cluster: str, cd4: str, cd8: tuple[str, str], counts: tuple[str, str, str] | None = None) -> DataFrame:
    """``cells`` with ``cd4_or_cd8`` by cluster (ties are cd8); with unlogged ``counts`` columns a clear
    cell (over 0.5 of one and under 0.5 of the other; 1.5 of both CD8 genes) gets its own tag."""
    tags = cluster_markers(cells, cluster, [cd4], list(cd8)).select(F.col("cluster").alias(cluster), F.when(F.col("cd4") > F.col("cd8"), "cd4").otherwise("cd8").alias("_tag"))
    out = cells.join(tags, cluster)
    tag = F.col("_tag")
    if counts:
        four, eight = F.col(counts[0]), F.col(counts[1]) + F.col(counts[2])
        tag = F.when((four > 0.5) & (eight < 0.5), "cd4").when((eight > 1.5) & (four < 0.5), "cd8").otherwise(tag)
    return out.withColumn("cd4_or_cd8", tag).drop("_tag")


def clone_vote(cells: DataFrame, allow_split: bool = True) -> DataFrame:
    """``cells`` (clone, cell, cd4_or_cd8) with ``subset``: the majority of the clone; a tie leaves each
    cell its own tag, or without ``allow_split`` the tag of the clone's first cell."""
    votes = cells.groupBy("clone").agg(F.count(F.when(F.col("cd4_or_cd8") == "cd4", 1)).alias("_n4"), F.count(F.when(F.col("cd4_or_cd8") == "cd8", 1)).alias("_n8"), F.min_by("cd4_or_cd8", "cell").alias("_first"))
    tie = F.col("cd4_or_cd8") if allow_split else F.col("_first")
    return cells.join(votes, "clone").withColumn("subset", F.when(F.col("_n4") > F.col("_n8"), "cd4").when(F.col("_n8") > F.col("_n4"), "cd8").otherwise(tie)).drop("_n4", "_n8", "_first")


def split_by_markers(cells: DataFrame, assign, max_rounds: int = 5, least: int = 25, allow_split: bool = True) -> DataFrame:
    """``cells`` (clone, cell, ...) with ``subset`` after rounds of clustering within each side and
    exchange. ``assign`` tags cells (adds cd4_or_cd8). Stops when no cell changes sides, a side has
    fewer than ``least`` cells, or after ``max_rounds``; then clones vote."""
    from bispace.session import work_table

    drop = lambda df: df.drop("cd4_or_cd8")
    now = work_table(assign(cells), "sides")
    for _ in range(max_rounds):
        sides = {r[0]: r[1] for r in now.groupBy("cd4_or_cd8").count().collect()}
        if min(sides.get("cd4", 0), sides.get("cd8", 0)) < least:
            break
        new = work_table(assign(drop(now.where("cd4_or_cd8 = 'cd4'"))).unionByName(assign(drop(now.where("cd4_or_cd8 = 'cd8'")))), "sides")
        moved = new.select("cell", F.col("cd4_or_cd8").alias("to")).join(now.select("cell", "cd4_or_cd8"), "cell").where("to <> cd4_or_cd8")
        settled = moved.isEmpty()
        now = now if settled else new
        if settled:
            break
    return clone_vote(now, allow_split)


def ribosomal_mean(normalised: DataFrame) -> DataFrame:
    """(cell, x): mean log-normalised value of ribosomal genes (RPS or RPL and a digit) over all of them."""
    r = normalised.where(F.upper("feature").rlike("^RP[SL][0-9]"))
    n = r.select("feature").distinct().count()
    cells = normalised.select("cell").distinct()
    return cells.join(r.groupBy("cell").agg(F.sum("x").alias("s")), "cell", "left").select("cell", (F.coalesce("s", F.lit(0.0)) / max(n, 1)).alias("x"))


def density_valley(values: DataFrame, start: float = 2.0, step: float = 0.01, bins: int = 4096) -> float:
    """The local minimum of a Gaussian kernel density next to ``start``, walking by ``step``.

    The driver gets a histogram of ``bins`` places, whatever the number of values; the kernel's width is
    Scott's. Without spread there is no minimum, and the start is returned.
    """
    s = values.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")).first()
    if not s["n"] or not s["sd"]:
        return start
    width = (s["hi"] - s["lo"]) / bins
    rows = values.groupBy(F.least(F.floor((F.col("x") - s["lo"]) / width), F.lit(bins - 1)).alias("k")).agg(F.count("*").alias("n"), F.avg("x").alias("x")).collect()
    x, n = (np.array([r[c] for r in rows], float) for c in ("x", "n"))
    h = s["sd"] * s["n"] ** -0.2
    dens = lambda at: float((n * np.exp(-((at - x) ** 2) / (2 * h * h))).sum())
    at, least, most = start, s["lo"] - 10 * h, s["hi"] + 10 * h
    while least < at < most:
        left, here, right = dens(at - step), dens(at), dens(at + step)
        move = -step if left < right and left < here else step if left >= right and right < here else 0
        if not move:
            return at
        at += move
    return at


def ribosomal_filter(normalised: DataFrame, start: float = 2.0) -> DataFrame:
    """Cells (cell, x) whose ribosomal mean lies above the valley of its density."""
    x = ribosomal_mean(normalised)
    return x.where(F.col("x") > density_valley(x, start))


# ---- ranked and redundant features -------------------------------------------------------------
def spread_labels(results: DataFrame, per_pair: int = 3) -> DataFrame:
    """Rows of results (p, id, feature, gex_cluster, tcr_cluster) to show: by p-value, at most
    ``per_pair`` for each pair of clusters, a feature once in a pair and a node once at all.

    Nodes belong to one pair, so pairs are independent and each is walked in order on its own; only
    its first rows by feature and by node can be shown, and only those go to the walk.
    """
    order = ["p", "id", "feature"]
    pair = ["gex_cluster", "tcr_cluster"]
    first = lambda *by: F.row_number().over(Window.partitionBy(*pair, *by).orderBy(*order))
    # a shown feature is shown at one of its first per_pair rows: fewer nodes than that are used before it
    slim = results.withColumns({"_f": first("feature"), "_n": first("id")}).where((F.col("_f") <= per_pair) & (F.col("_n") <= per_pair)).drop("_f", "_n")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        seen, used, out = set(), set(), []
        for k, r in enumerate(rows.sort_values(order).itertuples()):
            if len(out) == per_pair:
                break
            if r.feature not in seen and r.id not in used:
                seen.add(r.feature), used.add(r.id), out.append(k)
        return rows.sort_values(order).iloc[out]

    return slim.groupBy(*pair).applyInPandas(walk, slim.schema)


def feature_correlation(packed: DataFrame, names: list[str]) -> np.ndarray:
    """Pearson correlations of packed features (id, x) from sums of products; (F, F) numbers reach the driver."""
    width = len(names)
    import pyarrow as pa

    def sums(batches):
        n, s, ss = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        v = np.concatenate([[n], s, ss.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["k", "v"])

    got = np.zeros(1 + width + width * width)
    for r in packed.select("x").mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r["k"]] = r["v"]
    n, mean = max(got[0], 1), got[1 : 1 + width] / max(got[0], 1)
    cov = got[1 + width :].reshape(width, width) / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(cov / np.outer(sd, sd))


def uncorrelated(names: list[str], corr: np.ndarray, most: float = 0.9) -> list[str]:
    """Names in order, each kept if its correlation with all kept before is at most ``most``."""
    kept: list[int] = []
    for k in range(len(names)):
        if all(corr[k, j] <= most for j in kept):
            kept.append(k)
    return [names[k] for k in kept]


def ward_groups(distance: np.ndarray, most: int) -> list[int]:
    """Group numbers of a Ward linkage cut to at most ``most`` groups (Lance-Williams, ties by position)."""
    n = len(distance)
    d, size, groups = distance.astype(float).copy(), np.ones(n), {k: [k] for k in range(n)}
    np.fill_diagonal(d, np.inf)
    while len(groups) > most:
        live = sorted(groups)
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(sub)), len(live))
        a, b = sorted((live[i], live[j]))
        for k in live:
            if k not in (a, b):
                t = size[a] + size[b] + size[k]
                d[a, k] = d[k, a] = math.sqrt(max(0.0, ((size[a] + size[k]) * d[a, k] ** 2 + (size[b] + size[k]) * d[b, k] ** 2 - size[k] * d[a, b] ** 2) / t))
        size[a] += size[b]
        groups[a] += groups.pop(b)
    out = [0] * n
    for g, (_, members) in enumerate(sorted(groups.items())):
        for m in members:
            out[m] = g
    return out


def grouped_features(names: list[str], corr: np.ndarray, most: int) -> tuple[list[str], dict[str, list[str]]]:
    """The best-ranked feature of each Ward group of 1 - correlation, in order, and those it stands for."""
    if len(names) <= most:
        return list(names), {}
    groups = ward_groups(1 - corr, most)
    heads: dict[int, str] = {}
    same: dict[str, list[str]] = {}
    for name, g in zip(names, groups, strict=True):
        if g in heads:
            same.setdefault(heads[g], []).append(name)
        else:
            heads[g] = name
    return list(heads.values()), same
