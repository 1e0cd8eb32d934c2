"""Enriched CDR3 motifs: cores of three residues, pairs and triples of them, against a background.

Occurrences stay in tables; the driver holds the cores, pairs and triples that pass the limits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.session import work_table

#: Least occurrences, pseudocount, least enrichment and greatest adjusted p by number of
#: cores, greatest p at the end, and greatest similarity to a better motif.
MIN_COUNT, PSEUDO, ENRICH, MOST_P, FINAL_P, MOST_JACCARD = 5, 0.25, (1.05, 1.5, 2.0), (100.0, 1.0, 1.0), 1.0, 0.7


def core_occurrences(rows: DataFrame) -> DataFrame:
    """(id, core, n) of CDR3s (id, seq) trimmed and marked at both ends; a core's text shows its gaps as dots."""
    from bispace.operators.sequences import BACK, FRONT

    w = F.concat(F.lit("B"), F.expr(f"substring(seq, {FRONT + 1}, length(seq) - {FRONT + BACK})"), F.lit("Z"))
    spots = rows.where(F.length("seq") > FRONT + BACK).select("id", w.alias("w")).select("id", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("k"))
    gaps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (1, 2, 3) for y in (1, 2, 3)]))
    at = lambda k: F.substring("w", k, F.lit(1))
    each = spots.select("id", "w", "k", gaps.alias("g")).where(F.col("k") + F.col("g.x") + F.col("g.y") <= F.length("w"))
    dots = lambda g: F.repeat(F.lit("."), F.col(f"g.{g}") - 1)
    core = F.concat(at(F.col("k")), dots("x"), at(F.col("k") + F.col("g.x")), dots("y"), at(F.col("k") + F.col("g.x") + F.col("g.y")))
    return each.select("id", core.alias("core")).groupBy("id", "core").agg(F.count("*").alias("n"))


def kinds_of(rows: DataFrame) -> DataFrame:
    """(id, seq, m): rows (id, seq) of ids that have the same sequences as one, with their number and a number
    of their own as id."""
    each = rows.groupBy("id").agg(F.sort_array(F.collect_list("seq")).alias("seqs")).groupBy("seqs").agg(F.count("*").alias("m"))
    return work_table(each.withColumn("id", F.monotonically_increasing_id()), "kinds").select("id", F.explode("seqs").alias("seq"), "m")


def upper_tail(at_least: int, population: int, marked: int, drawn: int) -> float:
    """Hypergeometric P(X >= at_least) of plain numbers, added up from the likeliest value's side until the
    rest can't count, so work grows with the deviation, not with the population."""
    top, low = min(marked, drawn), max(at_least, marked + drawn - population, 0)
    if low > top:
        return 0.0
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = (marked + 1) * (drawn + 1) // (population + 2)
    start = min(max(low, mode), top)
    first = math.exp(choose(marked, start) + choose(population - marked, drawn - start) - choose(population, drawn))
    total = term = first
    for j in range(start, top):
        term *= (marked - j) * (drawn - j) / ((j + 1) * (population - marked - drawn + j + 1))
        total += term
        if term <= 1e-17 * total:
            break
    term = first
    for j in range(start, low, -1):
        term *= j * (population - marked - drawn + j) / ((marked - j + 1) * (drawn - j + 1))
        total += term
        if term <= 1e-17 * total:
            break
    return min(1.0, total)


@dataclass
class Motif:
    cores: tuple[str, ...]
    p: float
    enrich: float
    fg: int
    bg: int


def _parts(core: str) -> tuple[str, int]:
    """What two cores must share to overlap, the first two residues with their gap, and the second gap."""
    letters = [k for k, c in enumerate(core) if c != "."]
    return core[: letters[1] + 1], letters[2] - letters[1]


def overlap(a: str, b: str) -> bool:
    """Two cores overlap if they share two residues at the same distance and differ in where the third is."""
    (x, g), (y, h) = _parts(a), _parts(b)
    return x == y and g != h


def enriched_motifs(foreground: DataFrame, background: DataFrame) -> list[Motif]:
    """Motifs of the foreground's CDR3s (id, seq), best first, none like a better one.

    A set of cores occurs in a CDR3 as often as its rarest core. Adjusted p-values count the tests
    made so far, in order of the cores' ranks. Copies of a CDR3 are searched once and counted as many.
    """
    n_fg, n_bg = foreground.count(), background.count()
    if not n_fg or not n_bg:
        return []
    ratio = n_fg / n_bg
    sides = [core_occurrences(k).join(k.select("id", "m").distinct(), "id") for k in (kinds_of(foreground), kinds_of(background))]
    occ = work_table(sides[0].withColumn("fg", F.lit(True)).unionByName(sides[1].withColumn("fg", F.lit(False))), "cores")
    times = F.col("n") * F.col("m")
    counts = lambda df, *by: df.groupBy(*by).agg(F.sum(F.when(F.col("fg"), times).otherwise(0)).alias("f"), F.sum(F.when(F.col("fg"), 0).otherwise(times)).alias("b")).where(F.col("f") >= MIN_COUNT)
    enrich = lambda f, b: f / (max(PSEUDO, b) * ratio)
    p_of = lambda f, b: upper_tail(min(f, n_fg), n_fg + n_bg, min(f + b, n_fg + n_bg), n_fg)
    core_rows = counts(occ, "core").collect()
    tests = len(core_rows)
    good = [Motif((r["core"],), p_of(r["f"], r["b"]) * tests, enrich(r["f"], r["b"]), r["f"], r["b"]) for r in core_rows if enrich(r["f"], r["b"]) >= ENRICH[0]]
    singles = sorted((m for m in good if m.p <= MOST_P[0]), key=lambda m: (m.p, m.cores))
    spark = foreground.sparkSession

    def together(sets: list[tuple[str, ...]]) -> dict:
        """Occurrences of sets of cores in both tables."""
        if not sets:
            return {}
        wanted = spark.createDataFrame([(k, c) for k, s in enumerate(sets) for c in s], "k int, core string")
        size = len(sets[0])
        met = occ.join(F.broadcast(wanted), "core").groupBy("k", "fg", "id", "m").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") == size)
        return {sets[r["k"]]: (r["f"], r["b"]) for r in counts(met, "k").collect()}

    def grown(candidates: list[tuple[str, ...]], step: int, done: int) -> tuple[list[Motif], int]:
        found, out = together(list(dict.fromkeys(candidates))), []
        for s in candidates:
            if s in found:
                done += 1
                f, b = found[s]
                p = p_of(f, b) * done
                if enrich(f, b) >= ENRICH[step] and p <= MOST_P[step]:
                    out.append(Motif(s, p, enrich(f, b), f, b))
        return sorted(out, key=lambda m: (m.p, m.cores)), done

    names = [m.cores[0] for m in singles]
    alike: dict[str, list[int]] = {}
    for k, c in enumerate(names):
        alike.setdefault(_parts(c)[0], []).append(k)
    near = {c: [k for k in alike[_parts(c)[0]] if overlap(names[k], c)] for c in names}  # only cores of two equal residues can overlap
    pairs, tests = grown([(names[i], names[j]) for j in range(len(names)) for i in near[names[j]] if i < j], 1, tests)
    tries = [(i + k, i, k) for i, p in enumerate(pairs) for k in {k for x in p.cores for k in near[x]} if k > 0 and names[k] not in p.cores]
    triples, tests = grown([(*pairs[i].cores, names[k]) for _, i, k in sorted(tries)], 2, tests)
    every = sorted((m for m in singles + pairs + triples if m.p <= FINAL_P), key=lambda m: (m.p, m.cores))
    members: dict[tuple, dict] = {}
    kept: list[Motif] = []
    for size in (1, 2, 3):
        sets = [m.cores for m in every if len(m.cores) == size]
        if sets:
            wanted = spark.createDataFrame([(k, c) for k, s in enumerate(sets) for c in s], "k int, core string")
            met = occ.where("fg").join(F.broadcast(wanted), "core").groupBy("k", "id", "m").agg(F.count("*").alias("c")).where(F.col("c") == size)
            for r in met.groupBy("k").agg(F.collect_list(F.struct("id", "m")).alias("ids")).collect():
                members[sets[r["k"]]] = dict(r["ids"])
    for m in every:
        if all(jaccard(members[m.cores], members[x.cores]) <= MOST_JACCARD for x in kept):
            kept.append(m)
    return kept


def jaccard(a: dict, b: dict) -> float:
    """Similarity of two sets of kinds, given as the copies of each."""
    both = sum(n for k, n in a.items() if k in b)
    whole = sum(a.values()) + sum(b.values()) - both
    return both / whole if whole else 0.0
