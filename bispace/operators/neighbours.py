"""Exact nearest-neighbour graphs with group exclusion, and what is computed from their edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions.stats import hypergeometric_tail
from bispace.operators.distances import Top, fields, in_blocks, meetings, nearest
from bispace.operators.windows import running_sum

BLOCK = 512


def exclusion_knn(nodes: DataFrame, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(src, dst, dist, rank): each node's k nearest nodes by Euclidean distance, ties by id.

    ``nodes`` has id, ag, bg and the vector; nodes that share ag or bg are never neighbours, so a
    node with few eligible others gets a shorter list. Nodes are cut into blocks of bounded size, the
    smaller the larger k is, and every two blocks meet, as exactness takes; a block keeps a running top
    k while all others stream past it, so neither pairs nor lists are shuffled. Nodes with a null id, group or vector, or a null in the vector,
    have no neighbours and are nobody's; all vectors are of one length.
    """
    whole = nodes.select("id", "ag", "bg", F.col(vector).cast("array<double>").alias("v")).na.drop().where(F.forall("v", lambda x: x.isNotNull()))
    block = max(block, min(2048, whole.count() // 48))
    columns = ["id", "ag", "bg", "v"]
    (left, m), (right, n) = in_blocks(whole, columns, max(16, min(block, (4 << 20) // max(k, 1)))), in_blocks(whole, columns, block)
    return nearest(left, right, (m, n), apart_near, k)


def apart_near(x: dict, y: dict, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and Euclidean distances to nine decimals of pairs that share no group and are no further than i's limit.

    One product of matrices leaves out what is further even with its error; the rest is computed exactly.
    The product is in single precision where the squared lengths are, its error being in proportion to them.
    """
    xa, xb = (m["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(m["id"]), -1) for m in (x, y))
    with np.errstate(all="ignore"):  # vectors that aren't finite are at no distance
        sa, sb = (xa * xa).sum(1), (xb * xb).sum(1)
        size = np.concatenate([sa, sb])
        single = bool(((size == 0) | ((size > 1e-20) & (size < 1e20))).all())
        kind, error = (np.float32, (xa.shape[1] + 8) * 2.0**-22) if single else (np.float64, (xa.shape[1] + 8) * 2.0**-50)
        left = np.column_stack([xa, np.ones(len(xa))]).astype(kind)
        right = np.column_stack([-2 * xb, sb * (1 - error)]).astype(kind)
        reach = (limit + 1e-9) ** 2 - sa * (1 - error)
        near = np.flatnonzero(left @ right.T <= (reach + 1e-14 + error * np.abs(reach)).astype(kind)[:, None])
        i, j = np.divmod(near, len(xb))
        for g in ("ag", "bg"):
            own, other = x[g].to_numpy(zero_copy_only=False), y[g].to_numpy(zero_copy_only=False)
            apart = own[i] != other[j]
            i, j = i[apart], j[apart]
        d = np.zeros(len(i))
        for c in range(xa.shape[1]):
            d += (xa[i, c] - xb[j, c]) ** 2
        d = np.round(np.sqrt(d), 9)
        kept = np.isfinite(d) & (d <= limit[i])
    return i[kept], j[kept], d[kept]


def neighbour_density(edges: DataFrame) -> DataFrame:
    """(id, nndist): mean distance to neighbours, weights falling linearly from 1 to 1/K."""
    k = F.max("rank").over(Window.partitionBy("src"))
    w = F.when(F.col("k") > 1, 1 + (1 / F.col("k") - 1) * (F.col("rank") - 1) / (F.col("k") - 1)).otherwise(1.0)
    return edges.withColumn("k", k).groupBy(F.col("src").alias("id")).agg((F.sum(w * F.col("dist")) / F.sum(w)).alias("nndist"))


def group_sizes(nodes: DataFrame) -> DataFrame:
    """(id, same): nodes that share ag or bg with a node, itself included."""
    a, b, both = (nodes.groupBy(*c).agg(F.count("*").alias(n)) for c, n in ((["ag"], "na"), (["bg"], "nb"), (["ag", "bg"], "nab")))
    return nodes.join(a, "ag").join(b, "bg").join(both, ["ag", "bg"]).select("id", (F.col("na") + F.col("nb") - F.col("nab")).alias("same"))


def overlap(left: DataFrame, right: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, overlap, distinct): shared neighbours, and the smaller number of distinct groups in them."""
    shared = left.select("src", "dst").join(right.select("src", "dst"), ["src", "dst"]).join(nodes.select(F.col("id").alias("dst"), "ag", "bg"), "dst")
    found = shared.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("overlap"), F.least(F.countDistinct("ag"), F.countDistinct("bg")).alias("distinct"))
    return nodes.select("id").join(found, "id", "left").na.fill(0, ["overlap", "distinct"])


def two_step_p(o: Column, distinct: Column, population: Column, a: Column, b: Column, n: Column, threshold: float) -> Column:
    """Adjusted overlap p-value: N times the tail if more than expected, else N; a result under the
    threshold is taken again with the group-corrected overlap and lists shortened by as much."""
    first = F.when((o > 0) & (o > a * b / population), n * hypergeometric_tail(o, population, a, b)).otherwise(n.cast("double"))
    less = o - distinct
    again = n * hypergeometric_tail(distinct, population, a - less, b - less)
    return F.greatest(F.lit(1e-100), F.when((first <= threshold) & (distinct < o), again).otherwise(first))


def graph_vs_graph(left: DataFrame, right: DataFrame, nodes: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(id, overlap, p_adj) of every node: agreement of its neighbours in two graphs."""
    n = nodes.count()
    sizes = [g.groupBy(F.col("src").alias("id")).agg(F.count("*").alias(c)) for g, c in ((left, "ka"), (right, "kb"))]
    t = overlap(left, right, nodes).join(group_sizes(nodes), "id").join(sizes[0], "id", "left").join(sizes[1], "id", "left").na.fill(0, ["ka", "kb"])
    return tested(t, "ka", "kb", n, threshold)


def tested(t: DataFrame, a: str, b: str, n: int, threshold: float) -> DataFrame:
    # a node is few bytes but its tail hundreds of terms, so adaptive execution, which merges by bytes, mustn't merge these
    t = t.repartition(4 * t.sparkSession.sparkContext.defaultParallelism, "id")
    p = two_step_p(F.col("overlap"), F.col("distinct"), F.lit(n) - F.col("same"), F.col(a), F.col(b), F.lit(n), threshold)
    return t.select("id", "overlap", p.alias("p_adj"))


AGREEMENT = ["a", "b", "both", "both_groups", "left", "left_groups", "right", "right_groups"]


def agreement_rows(nodes: DataFrame, spaces: tuple[str, str], clusters: tuple[str, str]) -> tuple[DataFrame, list[int]]:
    """(id, ag, bg, v0, c0, v1, c1) of nodes with vectors of both spaces and clusters as numbers, 0 for none; the vectors' lengths."""
    columns = {"id": F.col("id"), "ag": F.col("ag"), "bg": F.col("bg")}
    rows = nodes.select("id", "ag", "bg", *(F.col(s).cast("array<double>").alias(f"v{k}") for k, s in enumerate(spaces)), *(F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.xxhash64(c)).alias(f"c{k}") for k, c in enumerate(clusters))).na.drop(subset=["id", "ag", "bg"])
    width = rows.agg(*(F.max(F.size(f"v{k}")).alias(f"v{k}") for k in range(2))).first()
    for k in range(2):  # a vector that isn't whole is near nothing
        odd = F.array_repeat(F.lit(float("nan")), max(width[k] or 1, 1))
        whole = F.col(f"v{k}").isNotNull() & F.forall(f"v{k}", lambda x: x.isNotNull())
        columns[f"v{k}"] = F.when(whole, F.col(f"v{k}")).otherwise(odd)
        columns[f"c{k}"] = F.col(f"c{k}")
    return rows.select(*(e.alias(c) for c, e in columns.items())), [width[k] or 1 for k in range(2)]


def agreement(nodes: DataFrame, spaces: tuple[str, str], ks: list[int], clusters: tuple[str, str], block: int = BLOCK) -> DataFrame:
    """(id, k, AGREEMENT): of a node's k nearest in two spaces (``a`` and ``b`` of them, as ``exclusion_knn`` has
    them) the shared ones, those of the left that are in its second cluster, and those of the right in its
    first, each with the smaller number of distinct groups.

    Lists of both spaces are met in the task that finds them and only their counts leave it, so disk doesn't
    grow with the edges; blocks shrink as the lists grow.
    """
    rows, _ = agreement_rows(nodes, spaces, clusters)
    columns, most = rows.columns, max(ks)
    block = max(block, min(2048, rows.count() // 96))
    (left, m), (right, n) = in_blocks(rows, columns, max(16, min(block, (2 << 20) // max(most, 1)))), in_blocks(rows, columns, block)

    def run(batches):
        now, mine, best, seen = None, None, [], []

        def done():
            every = {c: np.concatenate([s[c] for s in seen]) for c in ("id", "ag", "bg", "c0", "c1")}
            order = np.argsort(every["id"])
            every = {c: x[order] for c, x in every.items()}
            groups = [np.unique(every[g], return_inverse=True)[1] for g in ("ag", "bg")]
            size, total, tops = len(mine["id"]), len(every["ag"]), [t.settle() for t in best]
            tops = [(i, np.searchsorted(every["id"], to), rank) for i, _, to, rank in tops]
            own = [mine[c].to_numpy() for c in ("c0", "c1")]

            def counted(i, to):
                distinct = [np.bincount(np.unique(i * total + g[to]) // total, minlength=size) for g in groups]
                return [np.bincount(i, minlength=size), np.minimum(*distinct)]

            for k in ks:
                (i, to), (j, at) = ((i[rank < k], to[rank < k]) for i, to, rank in tops)
                shared = np.intersect1d(i * total + to, j * total + at, assume_unique=True)
                out = [np.bincount(i, minlength=size), np.bincount(j, minlength=size), *counted(shared // total, shared % total)]
                for rows_, dst, c in ((i, to, 1), (j, at, 0)):
                    same = (own[c][rows_] == every[f"c{c}"][dst]) & (own[c][rows_] != 0)
                    out += counted(rows_[same], dst[same])
                yield pa.RecordBatch.from_arrays([mine["id"], pa.array(np.full(size, k)), *map(pa.array, out)], names=["id", "k", *AGREEMENT])

        for batch in batches:
            for n in range(batch.num_rows):
                if batch.column("p")[n].as_py() != now:
                    if best:
                        yield from done()
                    now, mine, seen = batch.column("p")[n].as_py(), fields(batch.column("l")[n]), []
                    best = [Top(len(mine["id"]), most) for _ in range(2)]
                other = fields(batch.column("r")[n])
                seen.append({c: other[c].to_numpy(zero_copy_only=False) for c in ("id", "ag", "bg", "c0", "c1")})
                for s, top in enumerate(best):
                    i, j, d = apart_near({**mine, "v": mine[f"v{s}"]}, {**other, "v": other[f"v{s}"]}, top.limit)
                    top.add(i, d, seen[-1]["id"][j])
        if best:
            yield from done()

    return meetings(left, right, (m, n)).mapInArrow(run, "id long, k long, " + ", ".join(f"{c} long" for c in AGREEMENT))


def cluster_sizes(nodes: DataFrame, cluster: str) -> DataFrame:
    """(id, size): members of a node's cluster that share neither of its groups."""
    c = nodes.select("id", "ag", "bg", F.col(cluster).alias("c"))
    ks = [c.groupBy(*g).agg(F.count("*").alias(m)) for g, m in ((["c"], "nc"), (["c", "ag"], "na"), (["c", "bg"], "nb"), (["c", "ag", "bg"], "nab"))]
    return c.join(ks[0], "c").join(ks[1], ["c", "ag"]).join(ks[2], ["c", "bg"]).join(ks[3], ["c", "ag", "bg"]).select("id", (F.col("nc") - F.col("na") - F.col("nb") + F.col("nab")).alias("size"))


def graph_vs_cluster(edges: DataFrame, nodes: DataFrame, cluster: str, threshold: float = 1.0) -> DataFrame:
    """As graph_vs_graph, against the members of the node's own cluster outside its groups."""
    n = nodes.count()
    c, size = nodes.select("id", "ag", "bg", F.col(cluster).alias("c")), cluster_sizes(nodes, cluster)
    hit = edges.join(c.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("cd"), "ag", "bg"), "dst").where("cs = cd")
    found = hit.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("overlap"), F.least(F.countDistinct("ag"), F.countDistinct("bg")).alias("distinct"))
    k = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    t = size.join(group_sizes(nodes), "id").join(k, "id", "left").join(found, "id", "left").na.fill(0, ["k", "overlap", "distinct"])
    return tested(t, "k", "size", n, threshold)


def indegree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, indegree) with zero for nodes that are nobody's neighbour."""
    return nodes.select("id").join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indegree")), "id", "left").na.fill(0, ["indegree"])


def hotspot(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(feature, z) of features (id, feature, value; zeros left out of no one) on a graph: sum over
    edges of products less the mean's share, by variance and the root of the edge variance, in
    which a directed edge counts twice if its reverse exists."""
    stat = values.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    cross = edges.join(values.select(F.col("id").alias("src"), "feature", F.col("value").alias("xi")), "src").join(values.select(F.col("id").alias("dst"), "feature", F.col("value").alias("xj")), ["dst", "feature"])
    h = cross.groupBy("feature").agg(F.sum(F.col("xi") * F.col("xj")).alias("xx"), F.sum("xj").alias("xin"))
    back = edges.select("src", "dst").join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r")), ["src", "dst"], "left")
    v = back.agg(F.sum(F.when(F.col("r").isNotNull(), 2).otherwise(1)).alias("v"))
    z = (F.col("xx") - F.col("mean") * F.col("xin")) / F.greatest(F.lit(1e-9), F.col("var")) / F.sqrt("v")
    return h.join(stat, "feature").crossJoin(F.broadcast(v)).select("feature", F.when(F.col("var") == 0, 0.0).otherwise(z).alias("z"))


def neighbour_average(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id, avg): mean of a node's and its neighbours' values."""
    s = edges.join(values.select(F.col("id").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("value").alias("s"), F.count("*").alias("k"))
    return values.join(s, "id", "left").select("id", ((F.col("value") + F.coalesce("s", F.lit(0.0))) / (F.coalesce("k", F.lit(0)) + 1)).alias("avg"))


def neighbourhood_moments(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id, feature, n_fg, t): Welch statistic of a neighbourhood with its centre against the rest;
    the background's moments come from the totals by subtraction."""
    closed = edges.select("src", "dst").unionByName(values.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct())
    fg = closed.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "feature").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    all_ = values.groupBy("feature").agg(F.count("*").alias("m"), F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("tt"))
    j = fg.join(F.broadcast(all_), "feature").where("n >= 3 and m > n")
    var = lambda n, s, ss: F.greatest(F.lit(1e-12), ss / n - (s / n) * (s / n))
    n, s, ss, m = F.col("n"), F.col("s"), F.col("ss"), F.col("m") - F.col("n")
    bs, bss = F.col("t") - s, F.col("tt") - ss
    t = (s / n - bs / m) / F.sqrt(var(n, s, ss) / n + var(m, bs, bss) / m)
    return j.select("id", "feature", n.alias("n_fg"), t.alias("t"))


def mann_whitney_u(rows: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """U of the rows with ``group`` true against the others of the same key, with mid-ranks.

    Distinct values are ordered in ranges of (key, value), so a key of any size is many tasks.
    """
    each = rows.groupBy(*key, value).agg(F.count("*").alias("n"), F.sum(F.col(group).cast("long")).alias("f"))
    ranked = running_sum(each, key, [F.col(value)], F.col("n"), "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    got = ranked.groupBy(*key).agg(F.sum(F.col("rank") * F.col("f")).alias("r"), F.sum("f").alias("n1"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(3.0)) - F.col("n")).alias("ties"))
    return got.select(*key, "n1", (F.col("n") - F.col("n1")).alias("n2"), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "ties")
