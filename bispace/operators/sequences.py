"""Receptor sequences: distances, radius joins, background model, matching, motifs, properties."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bispace.operators.windows import dealt

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# Amino-acid distances other than 4 between different letters (unordered pairs).
CLOSE = {"AS": 3, "DE": 2, "DN": 3, "EK": 3, "EQ": 2, "FW": 3, "FY": 1, "HN": 3, "HY": 2, "IL": 2, "IM": 3, "IV": 1, "KQ": 3, "KR": 2, "LM": 2, "LV": 3, "MV": 3, "NS": 3, "QR": 3, "ST": 3, "WY": 2}
FRONT, BACK, GAP, WEIGHT = 3, 2, 12, 3
_CLOSE = np.array([[0 if a == b else CLOSE.get(a + b, CLOSE.get(b + a, 4)) for b in ALPHABET] for a in ALPHABET], np.uint8)


def letter_distance(a: Column, b: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair, d in CLOSE.items() for p in (pair, pair[::-1]) for x in (p, d)])
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(F.try_element_at(table, F.concat(a, b)), F.lit(4)))


def cdr3_distance(a: Column, b: Column) -> Column:
    """Distance of two CDR3s of at least five letters: ends trimmed, one fixed gap after
    ``min(6, 3 + (shorter - 5) div 2)`` letters, 3 per letter distance, 12 per unit of length."""
    n, m = F.length(a), F.length(b)
    short = F.least(n, m)
    gap = F.least(F.lit(6), F.lit(3) + F.floor((short - 5) / 2)).cast("int")
    at = lambda s, k: F.substring(s, k, F.lit(1))
    zero = F.lit(0)
    head = F.when(gap > FRONT, F.aggregate(F.sequence(F.lit(FRONT + 1), gap), zero, lambda t, k: t + letter_distance(at(a, k), at(b, k)))).otherwise(zero)
    rest = short - gap - BACK
    tail = F.when(rest > 0, F.aggregate(F.sequence(F.lit(1), rest), zero, lambda t, k: t + letter_distance(at(a, n - BACK - rest + k), at(b, m - BACK - rest + k)))).otherwise(zero)
    return WEIGHT * (head + tail) + GAP * F.abs(n - m)


def radius_join(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(i, j, d) of sequences (id, seq) within a radius.

    The length term alone is 12 per unit, so sequences meet by length and only lengths that can be
    in reach are joined: an equi-join, never a cross join. Within a length the first kept letters
    can't prune (any letter may differ), so its pairs are computed.
    """
    spread = radius // GAP
    a = left.select(F.col("id").alias("i"), F.col("seq").alias("s"), F.explode(F.sequence(F.length("seq") - spread, F.length("seq") + spread)).alias("len"))
    b = right.select(F.col("id").alias("j"), F.col("seq").alias("t"), F.length("seq").alias("len"))
    return a.join(b, "len").select("i", "j", cdr3_distance(F.col("s"), F.col("t")).alias("d")).where(F.col("d") <= radius)


def _kept(n: int, short: int) -> list[int]:
    """Places in a sequence of n letters that ``cdr3_distance`` compares with one whose shorter length is ``short``."""
    gap = min(6, 3 + (short - 5) // 2)
    return [*range(FRONT, gap), *range(n - BACK - (short - gap - BACK), n - BACK)]


class Windows:
    """Sequences to be met by many others: their ids, and for each other length tables of two letters' distances.

    Distances are whole multiples of WEIGHT. A sequence's row of distances to all of these is a sum of table
    rows, one for every two of its letters, which are added as bytes.
    """

    def __init__(self, rows: list[tuple], radius: int):
        rows = sorted(rows, key=lambda r: len(r[2]))
        self.ids, self.pos = (pa.array([r[k] for r in rows], pa.int64()) for k in range(2))
        self.radius, self.tables = radius, {}
        sizes, first = np.unique([len(r[2]) for r in rows], return_index=True)
        self.sides = {int(n): (int(at), _codes("".join(r[2] for r in part), int(n))) for n, at in zip(sizes, first, strict=True) for part in [[r for r in rows if len(r[2]) == n]]}

    def of_length(self, n: int) -> tuple[np.ndarray, list]:
        """Places of those whose length is in reach of ``n``, and tables (first, second letter's place or None, rows)."""
        if n not in self.tables:
            near = [(m, at, y) for m, (at, y) in self.sides.items() if GAP * abs(n - m) <= self.radius]
            places = np.concatenate([np.arange(at, at + len(y)) for _, at, y in near]) if near else np.zeros(0, np.int64)
            kind = np.uint8 if 4 * n + GAP // WEIGHT * (self.radius // GAP) < 256 else np.int32
            one, gaps, at = np.zeros((n, len(ALPHABET), len(places)), kind), np.zeros(len(places), kind), 0
            for m, _, y in near:
                here = slice(at, at := at + len(y))
                gaps[here] = GAP // WEIGHT * abs(n - m)
                for p, q in zip(_kept(n, min(n, m)), _kept(m, min(n, m)), strict=True):
                    one[p, :, here] = _CLOSE[:, y[:, q]]
            first = min(FRONT, n - 1)  # with no letter to compare, a table of gaps alone
            one[first] += gaps
            pairs = [(p, p + 1, (one[p][:, None] + one[p + 1]).reshape(len(ALPHABET) ** 2, len(places))) if p + 1 < n - BACK else (p, None, one[p]) for p in range(first, max(first + 1, n - BACK), 2)]
            self.tables[n] = places, pairs
        return self.tables[n]

    def met(self, seqs: list[str], block: int):
        """(at, places, d): blocks of ``seqs``, those of these in reach of their length, and distances over WEIGHT."""
        sizes = np.array([len(s) for s in seqs])
        for n in np.unique(sizes).tolist():
            places, tables = self.of_length(n)
            of_size = np.flatnonzero(sizes == n)
            for at in (of_size[k : k + block] for k in range(0, len(of_size), block)):
                a = _codes("".join(seqs[k] for k in at.tolist()), n)
                d = None
                for p, q, rows in tables:
                    part = rows[a[:, p] if q is None else a[:, p] * len(ALPHABET) + a[:, q]]
                    d = part if d is None else np.add(d, part, out=d)
                yield at, places, d


def _codes(text: str, n: int) -> np.ndarray:
    place = np.zeros(256, np.int64)
    place[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
    return place[np.frombuffer(text.encode(), np.uint8)].reshape(-1, n)


def _window_batches(left: DataFrame, right: DataFrame, radius: int, found, schema: str, block: int) -> DataFrame:
    """What ``found`` makes of blocks of the left's windows: their columns, the right's windows and distances in reach.

    The right is broadcast, so it must fit into memory; it is met in pieces of 4,096.
    """
    held = [tuple(r) for r in right.where("length(seq) >= 5").select("id", "pos", "seq").collect()]
    sent = left.sparkSession.sparkContext.broadcast([held[k : k + 4096] for k in range(0, len(held), 4096)])

    def run(batches):
        others = [Windows(rows, radius) for rows in sent.value]
        for batch in batches:
            yield from found(batch, others, batch.column("seq").to_pylist(), block)

    rows = left.where("length(seq) >= 5").select(F.col("id").cast("long"), F.col("pos").cast("long"), "seq")
    return rows.mapInArrow(run, schema)


def radius_windows(left: DataFrame, right: DataFrame, radius: int, block: int = 256) -> DataFrame:
    """(i, j, d) of windows (id, pos, seq) within a radius; i and j are structs of id and pos.

    All pairs of five letters or more meet, as in ``radius_join``, but as sums of rows of tables. The right
    is broadcast, so it must fit into memory; sequences of fewer than five letters have no distance.
    """

    def found(batch, others, seqs, block):
        for other in others:
            for at, places, d in other.met(seqs, block):
                hit = np.flatnonzero(d <= radius // WEIGHT)
                if len(hit):
                    i, j = np.divmod(hit, d.shape[1])
                    own, its = pa.array(at[i]), pa.array(places[j])
                    columns = [batch.column("id").take(own), batch.column("pos").take(own), other.ids.take(its), other.pos.take(its)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(d.ravel()[hit].astype(np.int64) * WEIGHT)], names=["i", "p", "j", "q", "d"])

    met = _window_batches(left, right, radius, found, "i long, p long, j long, q long, d long", block)
    return met.select(F.struct(F.col("i").alias("id"), F.col("p").alias("pos")).alias("i"), F.struct(F.col("j").alias("id"), F.col("q").alias("pos")).alias("j"), "d")


def _histograms(seqs: list[str], others: list[Windows], radius: int, block: int) -> np.ndarray:
    """For each sequence, how many of the others lie at 0, WEIGHT, 2 * WEIGHT and so on up to a radius."""
    steps = radius // WEIGHT + 1
    out = np.zeros((len(seqs), steps), np.int64)
    for other in others:
        for at, _, d in other.met(seqs, block):
            hit = np.flatnonzero(d < steps)
            out[at] += np.bincount(hit // max(d.shape[1], 1) * steps + d.ravel()[hit], minlength=len(at) * steps).reshape(len(at), steps)
    return out


def window_background(left: DataFrame, right: DataFrame, pairs: int, most: int, pseudo: float = 0.25, block: int = 256) -> DataFrame:
    """(id, pos, dist, freq) as ``background`` gives them where both chains of a query are a window of ``left``
    and the background is all of ``right``, of windows (id, pos) that don't repeat.

    A task counts a window's distances and convolves the counts, so pairs never leave it and nothing is shuffled.
    """

    def found(batch, others, seqs, block):
        for low in range(0, len(seqs), 4096):
            n = _histograms(seqs[low : low + 4096], others, most, block)
            both = np.zeros_like(n)
            for k in range(n.shape[1]):
                both[:, k:] += n[:, k : k + 1] * n[:, : n.shape[1] - k]
            i, k = np.nonzero(both)
            freq = np.maximum(pseudo, both.cumsum(1)[i, k]) / pairs
            own = pa.array(low + i)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(own), batch.column("pos").take(own), pa.array(k * WEIGHT), pa.array(freq)], names=["id", "pos", "dist", "freq"])

    return _window_batches(left, right, most, found, "id long, pos long, dist long, freq double", block)


def window_match_score(left: DataFrame, right: DataFrame, radius: int, sigma: float, block: int = 256) -> DataFrame:
    """The row of ``match_score`` for windows (id, pos) that don't repeat: a batch gives counts by distance, and the right's that it met."""

    def found(batch, others, seqs, block):
        n, rows = np.zeros(radius // WEIGHT + 1, np.int64), np.zeros(len(seqs), bool)
        for part, other in enumerate(others):
            seen = np.zeros(len(other.ids), bool)
            for at, places, d in other.met(seqs, block):
                near = d <= radius // WEIGHT
                n += np.bincount(d[near], minlength=len(n))
                rows[at] |= near.any(1)
                seen[places[near.any(0)]] = True
            its = part * 4096 + np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(its), "j")), pa.array(its), pa.array(np.ones(len(its), np.int64))], names=["kind", "k", "n"])
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(k) + ["i"]), pa.array([*(k * WEIGHT), 0], pa.int64()), pa.array([*n[k], rows.sum()], pa.int64())], names=["kind", "k", "n"])

    got = _window_batches(left, right, radius, found, "kind string, k long, n long", block).groupBy("kind", "k").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    soft = F.col("n") * F.exp(-F.col("k") * F.col("k") / F.lit(sigma * sigma))
    none = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return got.agg(none(of("d", F.col("n"))).alias("matches"), none(of("i", F.col("n"))).alias("n_left"), F.count(F.when(F.col("kind") == "j", 1)).alias("n_right"), of("d", soft).alias("soft"))


def match_score(matches: DataFrame, sigma: float) -> DataFrame:
    """One row: matches, distinct left and right, and the sum of exp(-d**2 / sigma**2)."""
    return matches.agg(F.count("*").alias("matches"), F.countDistinct("i").alias("n_left"), F.countDistinct("j").alias("n_right"), F.sum(F.exp(-F.col("d") * F.col("d") / F.lit(sigma * sigma))).alias("soft"))


def background(chain_a: DataFrame, chain_b: DataFrame, pairs: int, most: int, pseudo: float = 0.25) -> DataFrame:
    """(id, dist, freq): distances (i, d) of each query to background chains, convolved, summed up
    to each distance, floored at the pseudocount, over the number of background pairs."""
    a, b = (c.where(F.col("d") <= most).groupBy(F.col("i").alias("id"), F.col("d").alias("d" + x)).agg(F.count("*").alias("n" + x)) for c, x in ((chain_a, "a"), (chain_b, "b")))
    both = a.join(b, "id").withColumn("dist", F.col("da") + F.col("db")).where(F.col("dist") <= most).groupBy("id", "dist").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("id").orderBy("dist"))
    return both.select("id", "dist", (F.greatest(F.lit(pseudo), upto) / pairs).alias("freq"))


def strict_match(db: DataFrame, query: DataFrame, column: str) -> DataFrame:
    """Rows of ``db`` whose sequence occurs in ``query`` (id, seq), with the sorted ids there."""
    ids = query.groupBy(F.col("seq").alias(column)).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    return db.join(ids, column)


def anti_merge(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``base`` and those rows of ``more`` whose key it doesn't hold."""
    return base.unionByName(more.join(base.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def letter_counts(rows: DataFrame) -> DataFrame:
    """(id, letter, n) of sequences, dealt by id first: a task counts its own ids, not all that it read."""
    by_id, _ = dealt(rows.select("id", "seq"), "id", 50_000)
    return by_id.select("id", F.explode(F.split("seq", "")).alias("letter")).where("letter <> ''").groupBy("id", "letter").agg(F.count("*").alias("n"))


def pwm(rows: DataFrame) -> DataFrame:
    """(pos, letter, freq) over sequences of one length."""
    n = rows.select(F.posexplode(F.split("seq", "")).alias("pos", "letter")).where("letter <> ''").groupBy("pos", "letter").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("pos").agg(F.sum("n").alias("all")), "pos").select("pos", "letter", (F.col("n") / F.col("all")).alias("freq"))


def _tally(columns: list[np.ndarray]) -> list:
    """Distinct rows of columns of small numbers, each with its count."""
    sizes = [int(c.max(initial=0)) + 1 for c in columns]
    key = np.ravel_multi_index(columns, sizes) if len(columns[0]) else np.zeros(0, np.int64)
    if math.prod(sizes) <= 1 << 22:
        n = np.bincount(key)
        found = np.flatnonzero(n)
        n = n[found]
    else:
        found, n = np.unique(key, return_counts=True)
    return list(zip(zip(*(c.tolist() for c in np.unravel_index(found, sizes)), strict=True), n.tolist(), strict=True)) if len(found) else []


def _counted(rows: DataFrame, trim, counts, names: list[str], schema: str, most: int = 1 << 21) -> DataFrame:
    """(names, n): what ``counts`` finds in the letters of about ``most`` letters of sequences at a time, added up.

    ``counts`` takes the letters' code points, each letter's place among them, the sequences' starts and each
    letter's sequence, so what leaves a task is counts, not letters.
    """

    def found(texts):
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        size = np.array([len(t) for t in texts], np.int64)
        letters, at = np.unique(codes, return_inverse=True)
        got = list(counts(letters.tolist(), at, np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)))
        columns = [pa.array(c) for c in zip(*(k for k, _ in got), strict=True)] if got else [pa.array([], pa.string() if f.type == pa.string() else f.type) for f in types]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, pa.array([n for _, n in got], pa.int64())], [*types, pa.field("n", pa.int64())], strict=True)], names=[*names, "n"])

    types = [pa.field(c, {"int": pa.int32(), "string": pa.string()}[t]) for c, t in (f.split() for f in schema.split(", "))]

    def run(batches):
        texts, held = [], 0
        for batch in batches:
            more = [t for t in (trim(s) for s in batch.column(0).to_pylist() if s is not None) if t]
            texts += more
            held += sum(map(len, more))
            if held >= most:
                yield found(texts)
                texts, held = [], 0
        if texts:
            yield found(texts)

    return rows.select("seq").mapInArrow(run, f"{schema}, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def pwm_by_length(rows: DataFrame) -> DataFrame:
    """(len, pos, letter, freq): one matrix for each length, over all sequences."""

    def counts(letters, at, start, row):
        size, pos = np.diff(np.append(start, len(at)))[row], np.arange(len(at)) - start[row]
        for key, n in _tally([size, pos, at]):
            yield (int(key[0]), int(key[1]), chr(letters[key[2]])), n

    n = _counted(rows, lambda s: s, counts, ["len", "pos", "letter"], "len int, pos int, letter string")
    return n.join(n.groupBy("len", "pos").agg(F.sum("n").alias("all")), ["len", "pos"]).select("len", "pos", "letter", (F.col("n") / F.col("all")).alias("freq"))


def motif_cores(rows: DataFrame, spread: int = 3) -> DataFrame:
    """(core, n): three letters with gaps of up to ``spread`` - 1 between them in trimmed sequences
    between marks; every occurrence counts."""

    def counts(letters, at, start, row):
        for x in range(1, spread + 1):
            for y in range(1, spread + 1):
                m = max(len(at) - x - y, 0)
                ok = row[:m] == row[x + y :]
                for (a, b, c), n in _tally([at[:m][ok], at[x : x + m][ok], at[x + y :][ok]]):
                    yield (chr(letters[a]) + "." * (x - 1) + chr(letters[b]) + "." * (y - 1) + chr(letters[c]),), n

    return _counted(rows, lambda s: f"B{s[FRONT : max(FRONT, len(s) - BACK)]}Z", counts, ["core"], "core string")


def pwm_with_pseudocounts(rows: DataFrame, pseudo: float, alphabet: str = ALPHABET) -> DataFrame:
    """(len, pos, letter, freq): one matrix for each length, ``pseudo`` added to every letter's count;
    letters outside the alphabet are skipped, and a place with none but those has no row."""
    each = rows.select(F.length("seq").alias("len"), F.posexplode(F.split("seq", "")).alias("pos", "letter")).where(F.col("letter").isin(*alphabet))
    n = each.groupBy("len", "pos", "letter").agg(F.count("*").alias("n"))
    places = n.groupBy("len", "pos").agg(F.sum("n").alias("all")).withColumn("letter", F.explode(F.array(*map(F.lit, alphabet))))
    freq = (F.coalesce("n", F.lit(0)) + pseudo) / (F.col("all") + pseudo * len(alphabet))
    return places.join(n, ["len", "pos", "letter"], "left").select("len", "pos", "letter", freq.alias("freq"))
