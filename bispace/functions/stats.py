"""Tail probabilities and multiple testing as Column expressions, for any population size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ln_factorial(n: Column) -> Column:
    """ln(n!) of a whole number: a short table, then Stirling's series (error under 1e-13)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    return F.when(n < 20, F.element_at(table, n.cast("int") + 1)).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def hypergeometric_tail(at_least: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= at_least), summed from the upper tail so small values keep their precision.

    Terms further than 60 and twelve deviations from the mean, or from ``at_least`` beyond it, are
    under any double's reach of the sum and aren't computed, so work grows with the root of the size.
    An empty population gives 1 for nothing and 0 for more.
    """
    mean = F.coalesce(F.try_divide(marked.cast("double") * drawn, population), F.lit(0.0))
    reach = F.lit(60) + F.ceil(12 * F.sqrt(mean + 1))
    low = F.greatest(at_least, marked + drawn - population, F.lit(0))
    start = F.greatest(low.cast("long"), F.floor(mean) - reach)
    top = F.least(F.least(marked, drawn).cast("long"), F.greatest(low.cast("long"), F.floor(mean)) + reach)
    term = lambda j: F.exp(ln_choose(marked, j) + ln_choose(population - marked, drawn - j) - ln_choose(population, drawn))
    total = F.aggregate(F.sequence(start, F.greatest(start, top)), F.lit(0.0), lambda s, j: s + term(j))
    return F.when(low > F.least(marked, drawn), F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def poisson_tail(at_least: Column, mu: Column, terms: int = 200) -> Column:
    """P(X >= at_least): the tail's own terms, or 1 minus the lower ones where the mean is larger.

    Terms shrink away from the mean within some of its deviations; ``terms`` is their least number.
    """
    top = F.lit(terms) + F.ceil(12 * F.sqrt(mu))
    term = lambda j: F.exp(-mu + j * F.log(mu) - ln_factorial(j))
    total = lambda low, high: F.aggregate(F.sequence(low.cast("long"), high.cast("long")), F.lit(0.0), lambda s, j: s + term(j))
    upper = total(at_least, at_least + top)
    lower = F.greatest(F.lit(0.0), 1 - total(F.greatest(F.lit(0), at_least - 1 - top), F.greatest(F.lit(0), at_least - 1)))
    return F.when(at_least <= 0, F.lit(1.0)).when(mu <= 0, F.lit(0.0)).when(mu > at_least, lower).otherwise(upper)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "fdr", tests: Column | None = None, copies: str | None = None) -> DataFrame:
    """Adds step-up FDR over all rows of ``p``; ``tests`` pads the number of tests. A row counts as many
    times as its column ``copies`` says, once without one.

    Ranks come from counts of distinct p-values, so only distinct values are ordered, in ranges;
    ties share a rank, as in the usual procedure. A null p stays without an FDR.
    """
    from bispace.operators.windows import least_from_here, running_sum

    times = F.col(copies) if copies else F.lit(1)
    total = df.agg(F.sum(F.when(F.col(p).isNotNull(), times).otherwise(0)).cast("double").alias("_m")) if tests is None else df.sparkSession.range(1).select(tests.cast("double").alias("_m"))
    each = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_q")).agg(F.sum(times).alias("_k"))
    ranked = running_sum(each, [], [F.col("_q")], F.col("_k"), "_rank").crossJoin(F.broadcast(total))
    ranked = ranked.select("_q", (F.col("_q") * F.col("_m") / F.col("_rank")).alias("_f"))
    q = least_from_here(ranked, [F.col("_q")], "_f", "_least").select("_q", F.least(F.lit(1.0), "_least").alias(out))
    return df.join(q, df[p] == q["_q"], "left").drop("_q")


def normal_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal: a power series up to 3, beyond it a continued fraction."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(s, k):
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step, lambda s: s["sum"])
    far = density / (x + F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, k: k / (x + s)))
    upper = F.when(x < 3, series).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def mann_whitney_p(u: Column, n1: Column, n2: Column, ties: Column, two_sided: bool = True) -> Column:
    """Asymptotic p-value of U with corrections for ties and continuity; equal values give 1."""
    n = (n1 + n2).cast("double")
    variance = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    mean = n1 * n2 / 2
    away = (F.abs(u - mean) if two_sided else u - mean) - 0.5
    tail = normal_tail(away / F.sqrt(variance)) * (2 if two_sided else 1)
    return F.when(variance > 0, F.least(F.lit(1.0), tail)).otherwise(F.lit(1.0))


def student_two_sided(t: Column, df: Column, terms: int = 200) -> Column:
    """P(|T| >= |t|) of Student's distribution: the incomplete beta function's continued fraction.

    The fraction takes about the root of its larger argument to settle, so as many terms are added.
    """
    x = df / (df + t * t)

    def beta_fraction(a: Column, b: Column, x: Column) -> Column:
        # backwards from the last term, so that no running products are kept
        def step(s, k):
            m = k.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + even / (1 + odd / s)

        most = F.lit(terms) + F.ceil(4 * F.sqrt(F.greatest(a, b))).cast("int")
        inner = F.aggregate(F.sequence(most, F.lit(1), F.lit(-1)), F.lit(1.0), step)
        return 1 / (1 - (a + b) * x / (a + 1) / inner)

    def ln_gamma(y: Column) -> Column:
        # Stirling's series after shifting the argument by 10
        z = y + 10
        shift = sum((F.log(y + k) for k in range(10)), F.lit(0.0))
        return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - shift

    a, b = df / 2, F.lit(0.5)
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - math.lgamma(0.5) + a * F.log(x) + b * F.log(1 - x))
    near = front * beta_fraction(a, b, x) / a
    far = 1 - front * beta_fraction(b, a, 1 - x) / b
    return F.when(t == 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), near).otherwise(far)
