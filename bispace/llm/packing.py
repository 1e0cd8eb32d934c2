"""Operator 11 - best-fit packing by a configuration linear program over the histogram of lengths.

A configuration is a multiset of lengths that fits a sequence; the program covers all pieces of each
length with as few configurations as it can. It is solved by multiplicative weights: each length has a
weight, a knapsack dynamic program over the capacity prices all configurations at once (in its sum
form, so its answer is the Gibbs mixture of all good configurations instead of one), and a weight is
multiplied by how far the mixture's cover of its length lies from what is wanted. A price for unused
room is lowered step by step as long as the covers settle. Rounding draws configurations from the
mixture, takes them as often as the pieces allow, and solves again for what is left; the last pieces
go by best fit, largest first. Only the histogram (at most ``capacity`` numbers) reaches the driver,
and the plan's size depends on the capacity and the parameters, never on the table.

Documents are encoded once. Pieces are numbered by length within their task; totals by task and length
turn that into ranks, and ranks of a length are dealt to the plan's configurations in runs.

Defined cases: a null text is an empty one, so its piece is the end id alone; a document longer than
the capacity becomes pieces of ``capacity`` tokens after a first one that may be shorter; null ids and
repeated ids are documents of their own; other columns are left out, whatever their names; equal
lengths are dealt in the order of tasks and rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bispace.llm.bpe import codec, slices
from bispace.llm.common import Shared, broadcast_key, file_broadcast, tidy, worker_state
from bispace.llm.token_files import ByRank
from bispace.session import work_table

#: Prices of a unit of unused room, from almost free to almost forbidden.
ROOM = (0.99, 0.97, 0.95, 0.9, 0.8, 0.6, 0.3, 0.1, 0.03)
#: Rows of a task and length share one look-up row in this many.
STRIDE = 64

Pattern = tuple[tuple[int, int], ...]


def _tilted(w: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Weights times a power of the length so that they sum to one; no configuration's share changes
    but by the room it leaves."""
    log, lo, hi = np.log(w), -1.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        x = log - mid * lengths
        lo, hi = (mid, hi) if x.max() + np.log(np.exp(x - x.max()).sum()) > 0 else (lo, mid)
    return np.exp(np.clip(log - hi * lengths, -600, 0))


def _fills(lengths: np.ndarray, w: np.ndarray, capacity: int) -> np.ndarray:
    """Sum over all sequences of lengths that fill c exactly of the product of their weights, by c."""
    by_length = np.zeros(capacity + 1)
    by_length[lengths] = w
    back, z = by_length[::-1].copy(), np.zeros(capacity + 1)
    z[0] = 1
    for c in range(int(lengths[0]), capacity + 1):
        z[c] = back[capacity - c : capacity] @ z[:c]
    return z


def _cover(lengths: np.ndarray, w: np.ndarray, room: float, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The fills, and the expected number of each length in a configuration of the mixture."""
    z = _fills(lengths, w, capacity)
    free = room ** np.arange(capacity + 1)
    size = 1 << (2 * capacity + 1).bit_length()
    twice = np.fft.irfft(np.fft.rfft(z, size) ** 2, size)[: capacity + 1]
    around = np.fft.irfft(np.fft.rfft(twice, size) * np.fft.rfft(free, size), size)[: capacity + 1]
    return z, np.maximum(w * around[capacity - lengths] / (z[::-1] @ free), 1e-300)


def _fit(n: np.ndarray, lengths: np.ndarray, capacity: int, w: np.ndarray, room: float, rounds: int):
    """(weights, fills, sequences, share of tokens that are off) after rounds of multiplicative updates."""
    w = _tilted(w, lengths)
    for k in range(rounds):
        z, cover = _cover(lengths, w, room, capacity)
        sequences = (n @ lengths) / (cover @ lengths)
        wanted = n / (sequences * cover)
        off = (n * lengths) @ np.abs(1 / wanted - 1) / (n @ lengths)
        if off < 0.02 or k == rounds - 1 or not np.isfinite(off):
            return w, z, float(sequences), float(off)
        w = _tilted(np.maximum(w, 1e-290) * np.clip(wanted, 0.01, 100) ** 0.7, lengths)


def solve(n: np.ndarray, lengths: np.ndarray, capacity: int, w: np.ndarray, first: int, rounds: int = 40):
    """The mixture under the lowest price of room at which covers still settle: (weights, fills,
    sequences, index of the price), or None if they settle nowhere."""
    good = None
    with np.errstate(all="ignore"):  # a price that is too low runs out of range and is given up
        for k in range(first, len(ROOM)):
            w, z, sequences, off = _fit(n, lengths, capacity, w if good is None else good[0], ROOM[k], rounds)
            if not off <= 0.05 or not np.isfinite(w).all() or (good and sequences > good[2]):
                break
            good = (w, z, sequences, k)
    return good


def draw(lengths: np.ndarray, w: np.ndarray, z: np.ndarray, room: float, capacity: int, m: int, rng) -> list[Pattern]:
    """m configurations from a mixture, each a sorted tuple of (length, copies)."""
    free = np.cumsum(room ** np.arange(capacity + 1) * z[::-1])
    left = capacity - np.minimum(np.searchsorted(free, rng.random(m) * free[-1], "right"), capacity)
    steps = np.arange(capacity + 1)[:, None] - lengths
    shares = np.cumsum(np.where(steps >= 0, w * z[np.maximum(steps, 0)], 0), axis=1)
    total = shares[:, -1:]
    flat = (shares / np.where(total > 0, total, 1) + np.arange(capacity + 1)[:, None]).ravel()
    rows, seen_rows, seen = np.arange(m), [], []
    while True:
        rows, left = rows[left > 0], left[left > 0]
        if not len(rows):
            break
        item = np.searchsorted(flat, left + rng.random(len(left)) * (1 - 1e-9), "right") - left * len(lengths)
        item = np.clip(item, 0, np.searchsorted(lengths, left, "right") - 1)
        seen_rows.append(rows), seen.append(item)
        left = left - lengths[item]
    if not seen:
        return []
    key, copies = np.unique(np.concatenate(seen_rows) * len(lengths) + np.concatenate(seen), return_counts=True)
    cut = np.flatnonzero(np.diff(key // len(lengths))) + 1
    return [tuple(zip(i.tolist(), c.tolist(), strict=True)) for i, c in zip(np.split(lengths[key % len(lengths)], cut), np.split(copies, cut), strict=True)]


def best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best-fit decreasing of counts by length; equal bins are handled together."""
    spaces: dict[int, Counter] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            space = min((s for s in spaces if s >= length), default=None)
            if space is None:
                own, have, space = (), n, capacity
            else:
                own, have = spaces[space].popitem()
                if not spaces[space]:
                    del spaces[space]
            each = min(space // length, n)
            bins = min(have, n // each)
            if have > bins and own:
                spaces.setdefault(space, Counter())[own] += have - bins
            spaces.setdefault(space - each * length, Counter())[(*own, (length, each))] += bins
            n -= bins * each
    done = Counter()
    for held in spaces.values():
        for p, k in held.items():
            done[tuple(sorted(p))] += k
    return done


def plan(counts: np.ndarray, capacity: int, batches: int = 12, share: float = 0.35, most: int = 4096, seed: int = 1) -> Counter:
    """How often each configuration is used; ``counts[length]`` pieces are covered exactly.

    Pieces that leave no room for any other are sequences of their own. Of the others, each batch takes
    about ``share`` of what is left, by at most ``most`` configurations; best fit goes on after the
    batch (or before the first) from which it needs the fewest sequences.
    """
    rng, left = np.random.default_rng(seed), counts.astype(np.int64).copy()
    if not left.any():
        return Counter()
    alone = np.flatnonzero(left)
    alone = alone[alone > capacity - alone[0]]
    done = Counter({((int(i), 1),): int(left[i]) for i in alone})
    left[alone] = 0
    start, w, first, whole = done + best_fit(left, capacity), None, 0, None
    for _ in range(batches):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        n = left[lengths].astype(np.float64)
        found = solve(n, lengths, capacity, n / n.sum() if w is None else np.maximum(w[lengths], 1e-290), first)
        if found is None and (w is not None or first):
            found = solve(n, lengths, capacity, n / n.sum(), 0)
        if found is None:
            break
        own, z, sequences, price = found
        w, first = np.zeros(capacity + 1), max(0, price - 1)
        w[lengths] = own
        m = int(min(most, math.ceil(share * sequences)))
        each = max(1, round(share * sequences / m))
        for p in draw(lengths, own, z, ROOM[price], capacity, m, rng):
            times = min(each, *(int(left[i]) // c for i, c in p))
            if times:
                done[p] += times
                for i, c in p:
                    left[i] -= c * times
        now = done + best_fit(left, capacity)
        if whole is None or now.total() < whole.total():
            whole = now
    return start if whole is None or start.total() < whole.total() else whole


def runs(done: Counter) -> np.ndarray:
    """Rows (length, first rank, end rank, copies, first sequence, offset) by length and rank."""
    rank, out, sequence = Counter(), [], 0
    for p, times in sorted(done.items()):
        offset = 0
        for length, copies in p:
            out.append((length, rank[length], rank[length] + copies * times, copies, sequence, offset))
            rank[length] += copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _pieces(documents: DataFrame, path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """(part, k, doc_id, piece, start, length, ids) of all pieces; k counts a task's pieces of a length."""
    shared = file_broadcast(documents.sparkSession, path)
    by_rank = ByRank.proven(shared.value)
    source = documents.select(F.spark_partition_id().alias("part"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        own = worker_state(broadcast_key("rank", shared), lambda: ByRank(shared.value)) if by_rank else codec(shared)
        end, seen = end_id.to_bytes(4, "little"), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids = [e + end for e in own.encode(batch.column("text").to_pylist())]
                total = np.array([len(e) // 4 for e in ids])
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = (total - capacity * (n - 1))[row]
                start = np.where(piece == 0, 0, head + capacity * (piece - 1))
                length = np.where(piece == 0, head, capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered)
                cut = [ids[r][4 * s : 4 * (s + c)] for r, s, c in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").take(pa.array(row)), pa.array(seen[length] + place), batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(cut, pa.binary())],
                    names=["part", "k", "doc_id", "piece", "start", "length", "ids"],
                )
                seen += np.bincount(length, minlength=capacity + 1)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"part int, k long, doc_id {kind}, piece int, start long, length long, ids binary")


def pack(documents: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, str] = ("ids", "ids")) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids, sequence_id, offset) of all pieces; ``ids`` are
    little-endian unsigned 32-bit integers. ``carry`` names a column that takes the place of ``ids``, and
    its SQL over them, where less than the ids is wanted: only that is written and joined."""
    spark = documents.sparkSession
    made = _pieces(documents, path, capacity, end_id, doc_id, text).withColumn("carried", F.expr(carry[1])).drop("ids")
    pieces = work_table(made, "pieces")
    counts = work_table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    dealt = Shared(spark, runs(plan(histogram, capacity)))  # bounded by batches x most configurations

    def places(batches):
        table = dealt.value
        for batch in batches:
            out = []
            for part, length, n, base in zip(*(batch.column(c).to_pylist() for c in ("part", "length", "n", "base")), strict=True):
                lo, hi = np.searchsorted(table[:, 0], [length, length + 1])
                own = table[lo:hi]
                for at in range(0, n, STRIDE):
                    a, b = np.searchsorted(own[:, 2], base + at, "right"), np.searchsorted(own[:, 1], base + min(at + STRIDE, n), "left")
                    out.append((part, length, at // STRIDE, [{"until": e - base, "first": s - base, "copies": c, "sequence": q, "offset": o} for _, s, e, c, q, o in own[a:b].tolist()]))
            names = ["p", "l", "block", "runs"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([(f, pa.int64()) for f in ("until", "first", "copies", "sequence", "offset")]))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = work_table(based.mapInArrow(places, "p int, l long, block long, runs array<struct<until:long,first:long,copies:long,sequence:long,offset:long>>"), "places")
    joined = pieces.join(found, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")) & (F.floor(F.col("k") / STRIDE) == F.col("block")))
    joined = joined.withColumn("run", F.element_at(F.filter("runs", lambda r: r["until"] > F.col("k")), 1))
    t = F.col("k") - F.col("run.first")
    return joined.select(
        "doc_id", "piece", "start", "length", F.col("carried").alias(carry[0]), (F.col("run.sequence") + F.floor(t / F.col("run.copies"))).alias("sequence_id"), (F.col("run.offset") + t % F.col("run.copies") * F.col("length")).alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): whole sequences, at most a capacity of tokens each, for a
    trainer; ``ids`` is binary as in ``pack``, ``pieces`` says which document lies where."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("held"))
    ids = F.aggregate("held", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return held.select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_tokens"), ids.alias("ids"), F.transform("held", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("pieces"))
