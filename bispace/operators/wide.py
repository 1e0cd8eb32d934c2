"""Sums of wide feature arrays over neighbourhoods, as a blocked sparse product.

Nodes are dealt to blocks and features cut into parts, so a block of features is bounded whatever the
width; edges are grouped by the blocks of their two ends. An edge block meets each feature block of its
far end once and gives partial sums for its sources; partial sums of a block of sources are added up as
they stream through a task. The plan doesn't depend on the number of features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.session import work_table

ROWS, WIDTH = 256, 1024


def _matrix(lists, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def in_parts(packed: DataFrame, columns: list[str], width: int = WIDTH, more: tuple = ()) -> DataFrame:
    """(id, part, more, columns): arrays cut into slices of ``width``; an empty array gives no rows."""
    parts = F.sequence(F.lit(0), F.ceil(F.size(columns[0]) / width).cast("int") - 1)
    cut = packed.where(F.size(columns[0]) > 0).select("id", *more, *columns, F.explode(parts).alias("part"))
    return cut.select("id", "part", *more, *(F.slice(c, F.col("part") * width + 1, F.lit(width)).alias(c) for c in columns))


def neighbour_sums(edges: DataFrame, packed: DataFrame, columns: list[str], rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(id, part, n, columns): for each source of ``edges`` (src, dst) the number of its neighbours in
    ``packed`` (id, arrays of one length) and the sums of their arrays, by slices of ``width``.

    Neighbours that aren't in ``packed`` don't count; a repeated edge counts as often as it is there.
    """
    blocks = max(1, -(-packed.count() // rows))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    features = in_parts(packed, columns, width).withColumn("db", block("id")).groupBy("db", "part").agg(F.collect_list(F.struct("id", *columns)).alias("held"))
    features = work_table(features, "feature-blocks")
    ends = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    met = ends.select(block("src").alias("sb"), block("dst").alias("db"), "src", "dst").groupBy("sb", "db").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))

    def partial(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                held = batch.column("held")[k].values
                ids = held.field("id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids)
                src, dst = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("src", "dst"))
                at = np.minimum(np.searchsorted(ids[order], dst), len(ids) - 1)
                known = ids[order][at] == dst
                sources, of, n = np.unique(src[known], return_inverse=True, return_counts=True)
                if not len(sources):
                    continue
                count = np.zeros((len(sources), len(ids)))
                np.add.at(count, (of, order[at[known]]), 1)
                sums = [pa.array([(count @ _matrix(held.field(c), len(ids))).tobytes()], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([batch.column("sb").slice(k, 1), batch.column("part").slice(k, 1), pa.array([sources.tobytes()], pa.binary()), pa.array([n.astype(np.int64).tobytes()], pa.binary()), *sums], names=["sb", "part", "ids", "n", *columns])

    def added(batches):
        now, at, n, total = None, {}, [], []

        def done():
            ids = pa.array(list(at), pa.int64())
            flat = [np.stack(t) for t in total]
            offsets = lambda x: pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets(x), pa.array(x.ravel())) for x in flat]
            return pa.RecordBatch.from_arrays([ids, pa.array([now[1]] * len(at), pa.int32()), pa.array(n, pa.int64()), *lists], names=["id", "part", "n", *columns])

        for batch in batches:
            for k in range(batch.num_rows):
                key = (batch.column("sb")[k].as_py(), batch.column("part")[k].as_py())
                if key != now:
                    if at:
                        yield done()
                    now, at, n, total = key, {}, [], [[] for _ in columns]
                ids, more = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("ids", "n"))
                sums = [np.frombuffer(batch.column(c)[k].as_py(), np.float64).reshape(len(ids), -1) for c in columns]
                for row, i in enumerate(ids.tolist()):
                    place = at.setdefault(i, len(n))
                    if place == len(n):
                        n.append(int(more[row]))
                        for t, s in zip(total, sums, strict=True):
                            t.append(s[row].copy())
                    else:
                        n[place] += int(more[row])
                        for t, s in zip(total, sums, strict=True):
                            t[place] += s[row]
        if at:
            yield done()

    blobs = ", ".join(f"{c} binary" for c in columns)
    parts = met.join(features, "db").select("sb", "part", "src", "dst", "held").mapInArrow(partial, f"sb int, part int, ids binary, n binary, {blobs}")
    streamed = parts.repartition("sb", "part").sortWithinPartitions("sb", "part")
    return streamed.mapInArrow(added, "id long, part int, n long, " + ", ".join(f"{c} array<double>" for c in columns))


def summed(rows: DataFrame, column: str, width: int = WIDTH) -> DataFrame:
    """(pos, total): sums over rows (part, array) by place in the whole array."""
    return rows.select("part", F.posexplode(column).alias("p", "v")).groupBy((F.col("part") * width + F.col("p")).alias("pos")).agg(F.sum("v").alias("total"))
