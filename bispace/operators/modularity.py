"""Clusters of a weighted graph by modularity: local moves in rounds, then contraction, level by level.

In a round every node of a random part (by a hash of start, level, round and id) looks at the clusters of its
neighbours and goes to the one of greatest gain, ties to the smaller number. Nodes of one part move at
once, so a round can lose modularity; then the best state so far is taken up again and smaller parts
move. Once rounds gain nothing, clusters become nodes, with the sums of the edges between them, and the
next level begins. All state lies in tables: a round is a join of edges with labels, a sum by node and
cluster, and a join with the clusters' totals; only counts and the modularity reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.operators.windows import running_sum
from bispace.session import work_table

#: A hot cluster's rows are met in this many parts.
PARTS = 64


def with_totals(rows: DataFrame, totals: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row a key), dealt by (key, part of ``spread``).

    First the pairs of key and part, few of any key, meet the totals; so a key that a third of all rows
    share isn't one task.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    named = dealt.select(key, "_part").distinct().join(totals, key)
    return dealt.join(named, [key, "_part"]).drop("_part")


def undirected(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(u, v, w) both ways with summed weights; self edges, null ends and weights that are null or not
    positive are left out, a mutual edge counts twice."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w")).where("u <> v and w > 0")
    ends = F.array(F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return e.select(F.explode(ends).alias("e")).select("e.*").groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (id, cluster) on ``undirected`` edges; 0 without edges."""
    ends = graph.join(labels.select(F.col("id").alias("u"), F.col("cluster").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("cluster").alias("cv")), "v")
    total = ends.groupBy("cu").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("own"))
    s = total.agg(F.sum("k").alias("m"), F.sum("own").alias("own"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return s["own"] / s["m"] - resolution * s["kk"] / s["m"] ** 2 if s["m"] else 0.0


def _round(graph: DataFrame, state: DataFrame, m: float, resolution: float, salt: int, k: int, parts: int) -> DataFrame:
    """The next state (id, k, cluster), and of the one before: ``was``, ``own`` (the weight to other
    members of its cluster) and ``total`` (its cluster's sum of k). Edges bring the k of their first end."""
    kin = graph.join(state.select(F.col("id").alias("v"), "cluster"), "v").select(F.col("u").alias("id"), "cluster", "w", "k", F.lit(0).alias("here"))
    kin = kin.unionByName(state.select("id", "cluster", F.lit(0.0).alias("w"), "k", F.lit(1).alias("here")))
    offers = kin.groupBy("id", "cluster").agg(F.sum("w").alias("w"), F.first("k").alias("k"), (F.max("here") > 0).alias("here"))
    offers = with_totals(offers, state.groupBy("cluster").agg(F.sum("k").alias("total")), "cluster", "id")
    gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("total") - F.when(F.col("here"), F.col("k")).otherwise(0.0)) / m, 9)
    own = lambda c: F.max(F.when(F.col("here"), F.col(c))).alias(c)
    best = offers.withColumn("gain", gain).groupBy("id").agg(
        F.first("k").alias("k"), own("cluster"), own("w"), own("total"), own("gain"), F.min(F.struct((-F.col("gain")).alias("g"), "cluster")).alias("to")
    )
    moves = (-F.col("to.g") > F.col("gain")) & (F.pmod(F.xxhash64("id", F.lit(salt), F.lit(k)), F.lit(parts)) == 0)
    return best.select("id", "k", F.col("cluster").alias("was"), F.col("w").alias("own"), "total", F.when(moves, F.col("to.cluster")).otherwise(F.col("cluster")).alias("cluster"))


def _settled(graph: DataFrame, state: DataFrame, inside: float, m: float, resolution: float, salt: int, rounds: int, least_gain: float) -> tuple[DataFrame, float]:
    """Rounds of local moves from a state: the best state met and its modularity; ``inside`` is the
    weight within the nodes themselves."""
    best, highest, parts, calm = None, float("-inf"), 2, 0
    for k in range(rounds + 1):
        new = work_table(_round(graph, state, m, resolution, salt, k, parts), "moves")
        s = new.agg(F.sum("own").alias("own"), F.sum(F.col("k") * F.col("total")).alias("squares"), F.count(F.when(F.col("cluster") != F.col("was"), 1)).alias("moved")).first()
        q = (s["own"] + inside) / m - resolution * s["squares"] / m**2
        if q < highest:  # too many moved at once
            parts *= 2
            state = best
            if parts > 16:
                break
            continue
        calm = calm + 1 if q - highest < least_gain else 0
        best, highest = state, q
        if calm > 1 or (not s["moved"] and calm):
            break
        state = new.select("id", "k", "cluster")
    return best, highest


def _contracted(graph: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Clusters as nodes: their edges, a state in which each is its own cluster, and the weight that is
    now within nodes."""
    ends = [state.select(F.col("id").alias(x), F.col("cluster").alias("c" + x)) for x in "uv"]
    between = graph.join(ends[0], "u").join(ends[1], "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
    between = work_table(between, "between")
    whole = work_table(state.groupBy("cluster").agg(F.sum("k").alias("k")).select(F.col("cluster").alias("id"), "k", "cluster"), "state")
    inside = between.where("u = v").agg(F.sum("w")).first()[0] or 0.0
    return between.where("u <> v").join(whole.select(F.col("id").alias("u"), "k"), "u"), whole, inside


def modularity_clusters(edges: DataFrame, nodes: DataFrame, weight: str | None = None, resolution: float = 1.0, levels: int = 10, rounds: int = 24, starts: int = 2, least_gain: float = 1e-3) -> DataFrame:
    """(id, cluster) of all nodes, clusters numbered from 0 by size, ties by their smallest id.

    Edges are (src, dst) with a weight column if named, and count in both directions. Of ``starts`` runs
    from single nodes the best one stays; a last run lets single nodes move again from its clusters, and
    is taken if it gains. Defined cases: nodes without edges are clusters of their own; null ids of
    ``nodes`` are left out and repeated ones taken once, ends that aren't in ``nodes`` are ignored; an
    empty table gives an empty one.
    """
    ids = work_table(nodes.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct(), "nodes")
    linked = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    links = work_table(undirected(linked, weight), "links")  # edges that are costly to find are found once
    degree = work_table(links.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    whole = work_table(links.join(degree.select(F.col("id").alias("u"), "k"), "u"), "graph")
    m = degree.agg(F.sum("k")).first()[0]
    of, highest = ids.select("id", F.col("id").alias("cluster")), float("-inf")
    for start in range(starts + 1 if m else 0):
        first = of if start == starts else ids.select("id", F.col("id").alias("cluster"))
        graph, state, inside = whole, work_table(degree.join(first, "id").select("id", "k", "cluster"), "state"), 0.0
        labels, before = None, float("-inf")
        for level in range(levels):
            state, q = _settled(graph, state, inside, m, resolution, 100 * start + level, rounds, least_gain)
            if labels is None:
                labels = state.select("id", "cluster")
            else:
                labels = work_table(labels.join(state.select(F.col("id").alias("cluster"), F.col("cluster").alias("next")), "cluster").select("id", F.col("next").alias("cluster")), "clusters")
            if q - before < least_gain:
                break
            before = q
            graph, state, more = _contracted(graph, state)
            inside += more
        if q <= highest:
            continue
        highest = q
        of = work_table(ids.join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")
    sizes = of.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    number = running_sum(sizes, [], [F.desc("n"), F.col("least")], F.lit(1), "k").select("cluster", (F.col("k") - 1).alias("number"))
    return with_totals(of, number, "cluster", "id").select("id", F.col("number").alias("cluster"))
