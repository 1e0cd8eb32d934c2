"""Junctions of receptor genes: alignment to V, D and J, better alleles, resampled chains, bases of a protein.

Genes are a small table at the driver (gene, chain, region, nuc): the bases of V genes from the CDR3's
first codon on, of J genes up to its last, of D genes whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bispace.functions.scores import GENETIC_CODE, SYMBOLS
from bispace.operators.windows import running_sum

#: What a mismatch costs, what a better allele must gain, and how common it must be.
MISMATCH, MIN_GAIN, MIN_RATIO, MIN_COUNT = -4, 2, 10, 5

PLAIN = frozenset("acgt")


def like(a: str, b: str) -> bool:
    return a == b or bool(set(SYMBOLS.get(a, a)) & set(SYMBOLS.get(b, b)))


def matched(a: str, b: str, mismatch: int = MISMATCH) -> int:
    """Length of the stretch from the start with the best score, the longest of equal ones."""
    best = score = length = 0
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        score += 1 if like(x, y) else mismatch
        if score >= best:
            best, length = score, k + 1
    return length


def first_run(seq: str, middle: str, size: int) -> tuple[int, int] | None:
    """Places of the first run of ``size`` bases of ``seq`` that is like one of ``middle``; plain bases are like themselves only."""
    if PLAIN.issuperset(seq) and PLAIN.issuperset(middle):
        return next(((s, p) for s in range(len(seq) - size + 1) if (p := middle.find(seq[s : s + size])) >= 0), None)
    return next(((s, p) for s in range(len(seq) - size + 1) for p in range(len(middle) - size + 1) if all(like(x, y) for x, y in zip(seq[s : s + size], middle[p : p + size], strict=True))), None)


@dataclass
class Genes:
    v: dict[str, str]
    j: dict[str, str]
    d: dict[str, str]

    @staticmethod
    def of(rows) -> Genes:
        by = {"V": {}, "J": {}, "D": {}}
        for r in rows:
            by[r["region"]][r["gene"]] = r["nuc"].lower()
        return Genes(by["V"], by["J"], dict(sorted(by["D"].items())))


def parse(v: str, j: str, nuc: str, d: dict[str, str]) -> dict:
    """Source of each base of a junction (V, D, J or N), trims and inserts.

    V takes its matched stretch from the front, J from the back; where they meet, the overlap is cut from
    both, half of it from V. D is the longest run of a D gene in what is left, the first such one.
    """
    nv, nj = matched(v, nuc), matched(j[::-1], nuc[::-1])
    over = max(0, nv + nj - len(nuc))
    nv, nj = nv - over // 2, nj - (over - over // 2)
    middle = nuc[nv : len(nuc) - nj]
    best = ("", 0, 0, 0, 0)
    for name, seq in d.items():
        for size in range(min(len(seq), len(middle)), len(best[0]) if best[0] else 0, -1):
            hit = first_run(seq, middle, size)
            if hit and size > best[2]:
                best = (name, hit[0], size, hit[1], len(seq) - hit[0] - size)
                break
    name, start, size, pos, rest = best
    source = "V" * nv + "N" * pos + "D" * size + "N" * (len(middle) - pos - size) + "J" * nj if size else "V" * nv + "N" * len(middle) + "J" * nj
    inserts = (pos, len(middle) - pos - size, 0) if size else (0, 0, len(middle))
    return {"source": source, "d_gene": name or None, "v_trim": len(v) - nv, "d0_trim": start, "d1_trim": rest, "j_trim": len(j) - nj, "n_vd": inserts[0], "n_dj": inserts[1], "n_vj": inserts[2]}


def masked(protein: str, source: str) -> str:
    """A CDR3 with letters all of whose bases are from genes as '-', those with one inserted base in lower case."""
    out = []
    for k, a in enumerate(protein):
        n = source[3 * k : 3 * k + 3].count("N")
        out.append(a if n > 1 else a.lower() if n else "-")
    return "".join(out)


JUNCTION = "source string, masked string, d_gene string, v_trim int, d0_trim int, d1_trim int, j_trim int, n_vd int, n_dj int, n_vj int"


def parse_junctions(chains: DataFrame, genes: Genes) -> DataFrame:
    """``chains`` (id, v, j, cdr3, nt, chain) with the parse of their junction; nulls where a gene is unknown
    or the bases aren't the protein's."""

    @F.pandas_udf(JUNCTION)
    def run(v: pd.Series, j: pd.Series, cdr3: pd.Series, nt: pd.Series, chain: pd.Series) -> pd.DataFrame:
        names = [p.split()[0] for p in JUNCTION.split(", ")]
        out = []
        for a, b, p, s, c in zip(v, j, cdr3, nt, chain, strict=True):
            if a not in genes.v or b not in genes.j or not s or not p or len(s) != 3 * len(p):
                out.append(dict.fromkeys(names))
                continue
            row = parse(genes.v[a], genes.j[b], s.lower(), genes.d if c == "B" else {})
            out.append(row | {"masked": masked(p, row["source"])})
        return pd.DataFrame(out, columns=names)

    return chains.withColumn("junction", run("v", "j", "cdr3", "nt", "chain"))


def better_alleles(chains: DataFrame, genes: Genes) -> DataFrame:
    """``chains`` (id, v, j, nt) with alleles that explain more of the bases, where such a swap is common.

    An allele must match two bases more than the given one, the best of those wins. A swap is made if the
    allele is the commonest choice for its gene, or the second with a tenth of the first's count and five.
    """

    def best(given: str, table: dict[str, str], nuc: str, back: bool) -> str:
        if given not in table:
            return given
        turn = (lambda s: s[::-1]) if back else (lambda s: s)
        top, most = given, matched(turn(table[given]), turn(nuc))
        for other in sorted(g for g in table if g.startswith(given.split("*")[0] + "*") and g != given):
            n = matched(turn(table[other]), turn(nuc))
            if n > most and (top != given or n - most >= MIN_GAIN):
                top, most = other, n
        return top

    @F.pandas_udf("new_v string, new_j string")
    def run(v: pd.Series, j: pd.Series, nt: pd.Series) -> pd.DataFrame:
        rows = [(a and best(a, genes.v, (s or "").lower(), False), b and best(b, genes.j, (s or "").lower(), True)) for a, b, s in zip(v, j, nt, strict=True)]
        return pd.DataFrame(rows, columns=["new_v", "new_j"])

    tried = chains.withColumn("_n", run("v", "j", "nt"))
    choice = tried.select(F.explode(F.array(F.struct(F.col("v").alias("g"), F.col("_n.new_v").alias("to")), F.struct(F.col("j").alias("g"), F.col("_n.new_j").alias("to")))).alias("c")).select("c.*")
    n = choice.groupBy("g", "to").agg(F.count("*").alias("n"))
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "to"))).where("r <= 2")
    two = ranked.groupBy("g").agg(F.max(F.when(F.col("r") == 1, F.struct("to", "n"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("to", "n"))).alias("b"))
    often = F.col("b").isNotNull() & (F.col("b.n") >= F.floor(F.col("a.n") / MIN_RATIO)) & (F.col("b.n") >= MIN_COUNT)
    swap = two.select("g", F.when(F.col("a.to") != F.col("g"), F.col("a.to")).when(often, F.col("b.to")).alias("allowed")).where("allowed is not null").select("allowed").distinct()
    out = tried
    for c in ("v", "j"):
        out = out.join(F.broadcast(swap.withColumnRenamed("allowed", f"_{c}")), F.col(f"_n.new_{c}") == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return out.drop("_n")


def breakpoints(source: str) -> tuple[set[int], set[int]]:
    """Places where a junction may be cut, before and after its D: not within V, D or J. Places count from
    the front, and, negative, from the back."""
    before, after, past = set(), set(), False
    for k in range(1, len(source)):
        past = past or source[k - 1] == "D"
        if source[k - 1] != source[k] or source[k] == "N":
            (after if past else before).update((k, k - len(source)))
    return before, after


def spliced(one: dict, two: dict, seed: str) -> tuple[str, str] | None:
    """(bases, protein) of the first junction's front and the second's back at a shared place drawn by a
    hash; none if there is no such place or a stop codon."""
    if one["nt"] == two["nt"]:
        return None
    draw = int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "little")
    kinds = list(zip(breakpoints(one["source"]), breakpoints(two["source"]), strict=True))
    for a, b in kinds[:: 1 if draw % 2 else -1]:
        shared = sorted(a & b)
        if not shared:
            continue
        at = shared[(draw >> 1) % len(shared)]
        nuc = one["nt"][:at] + two["nt"][at:]
        protein = "".join(GENETIC_CODE.get(nuc[k : k + 3], "X") for k in range(0, len(nuc) - len(nuc) % 3, 3))
        if len(nuc) % 3 == 0 and "*" not in protein:
            return nuc, protein
    return None


def resampled_chains(parsed: DataFrame, n: int, seed: int = 1, keep_vj: bool = False, rounds: int = 20) -> DataFrame:
    """(v, j, cdr3, nt): ``n`` chains spliced of two of ``parsed`` (id, v, j, nt, junction) each.

    Partners are drawn by hash and met by joins on their row numbers, in rounds that double the draws
    until there are enough; the first ``n`` by draw are taken. ``keep_vj`` takes a third chain's V gene
    for the first partner and its J gene for the second.
    """
    rows = parsed.where("junction.source is not null").select(F.col("id").cast("string").alias("id"), "v", "j", F.lower("nt").alias("nt"), "junction.source")
    stem = lambda c: F.substring_index(c, "*", 1)
    numbered = running_sum(rows, [], [F.col("id")], F.lit(1), "k").withColumn("k", F.col("k") - 1)
    total = numbered.count()
    if not total:
        return parsed.sparkSession.createDataFrame([], "v string, j string, cdr3 string, nt string")
    from bispace.session import work_table

    numbered = work_table(numbered, "chains")
    chain = F.struct("v", "j", "nt", "source")
    if keep_vj:
        of_v, of_j = (running_sum(numbered.withColumn("g", stem(c)), ["g"], [F.col("k")], F.lit(1), "at").withColumn("at", F.col("at") - 1).withColumn("x", chain) for c in ("v", "j"))
        size_v, size_j = (t.groupBy("g").agg(F.count("*").alias("m")) for t in (of_v, of_j))

    @F.pandas_udf("nt string, cdr3 string")
    def splice(a: pd.DataFrame, b: pd.DataFrame, k: pd.Series) -> pd.DataFrame:
        found = [spliced(x, y, f"{seed}-{i}") for x, y, i in zip(a.to_dict("records"), b.to_dict("records"), k, strict=True)]
        return pd.DataFrame([f or (None, None) for f in found], columns=["nt", "cdr3"])

    draws = 2 * n
    for _ in range(rounds):
        pick = lambda tag, m: F.pmod(F.xxhash64(F.lit(f"{seed}-{tag}"), "draw"), m)
        drawn = parsed.sparkSession.range(draws).withColumnRenamed("id", "draw")
        if keep_vj:
            third = drawn.withColumn("k", pick("t", F.lit(total))).join(numbered.select("k", stem("v").alias("gv"), stem("j").alias("gj")), "k").drop("k")
            for t, size, g, out in ((of_v, size_v, "gv", "a"), (of_j, size_j, "gj", "b")):
                third = third.join(size.withColumnRenamed("g", g), g).withColumn("at", pick(out, F.col("m"))).drop("m").join(t.select(F.col("g").alias(g), "at", F.col("x").alias(out)), [g, "at"]).drop("at")
            met = third.select("draw", "a", "b")
        else:
            met = drawn.withColumn("k", pick("a", F.lit(total))).join(numbered.select("k", chain.alias("a")), "k").drop("k")
            met = met.withColumn("k", pick("b", F.lit(total))).join(numbered.select("k", chain.alias("b")), "k").drop("k")
        made = work_table(met.withColumn("s", splice("a", "b", "draw")).where("s.nt is not null").select("draw", F.col("a.v").alias("v"), F.col("b.j").alias("j"), F.col("s.cdr3").alias("cdr3"), F.col("s.nt").alias("nt")), "spliced")
        if made.count() >= n:
            break
        draws *= 2
    else:
        raise RuntimeError(f"fewer than {n} chains could be spliced")
    first = running_sum(made, [], [F.col("draw")], F.lit(1), "at")
    return first.where(F.col("at") <= n).select("v", "j", "cdr3", "nt")


def back_translated(v: str, j: str, protein: str) -> str | None:
    """Bases of a CDR3 that take most from its V gene's front and J gene's back; inserted codons take the
    first by the order c, g, t, a. None if a letter has no codon."""
    codons: dict[str, list[str]] = {}
    for codon, a in GENETIC_CODE.items():
        codons.setdefault(a, []).append(codon)
    if any(a not in codons for a in protein):
        return None
    order = str.maketrans("cgta", "0123")
    front = [max(codons[a], key=lambda c, k=k: (_prefix(c, v[3 * k : 3 * k + 3]), -int(c.translate(order)))) for k, a in enumerate(protein)]
    n_v = 0
    for k, c in enumerate(front):
        n = _prefix(c, v[3 * k : 3 * k + 3])
        n_v += n
        if n < 3:
            break
    back, rev, n_j = [], j[::-1], 0
    for k, a in enumerate(reversed(protein)):
        c = max(codons[a], key=lambda c, k=k: (_prefix(c[::-1], rev[3 * k : 3 * k + 3]), -int(c.translate(order))))
        back.append(c)
    back.reverse()
    for k, c in enumerate(reversed(back)):
        n = _prefix(c[::-1], rev[3 * k : 3 * k + 3])
        n_j += n
        if n < 3:
            break
    cut = min(len(protein), -(-n_v // 3))
    start = max(cut, len(protein) - -(-n_j // 3))
    plain = [max(codons[a], key=lambda c: -int(c.translate(order))) for a in protein]
    return "".join(front[:cut] + plain[cut:start] + back[start:])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def back_translate(chains: DataFrame, genes: Genes) -> DataFrame:
    """``chains`` (v, j, cdr3) with ``nt``; null where a gene is unknown."""

    @F.pandas_udf("string")
    def run(v: pd.Series, j: pd.Series, cdr3: pd.Series) -> pd.Series:
        return pd.Series([back_translated(genes.v[a], genes.j[b], p) if a in genes.v and b in genes.j and p else None for a, b, p in zip(v, j, cdr3, strict=True)])

    return chains.withColumn("nt", run("v", "j", "cdr3"))
