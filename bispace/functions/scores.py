"""Scores of receptors as Column expressions, and strings: properties, models, translation, matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
TRIM, CENTER = 4, 5
#: Hydropathy of the amino acids (Kyte and Doolittle) and their charge.
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
CHARGE = {"D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0}


def _count(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def loop(cdr3: Column) -> Column:
    """A CDR3 without the four letters at each end; empty if there are no more."""
    return F.substring(cdr3, F.lit(TRIM + 1), F.greatest(F.length(cdr3) - 2 * TRIM, F.lit(0)))


def center(cdr3: Column) -> Column:
    """The five letters in the middle of a CDR3 without its first letter; empty if there are fewer."""
    n = F.length(cdr3) - 1
    return F.when(n >= CENTER, F.substring(cdr3, F.floor((n - CENTER) / 2).cast("int") + 2, F.lit(CENTER))).otherwise(F.lit(""))


def property_score(cdr3: Column, values: dict[str, float], mode: str = "fg") -> Column:
    """Mean of a property over a CDR3's loop (``fg``) or center (``cen``); without letters the mean over the 20.

    Letters are counted by replacement, so the expression stays in generated code."""
    part = {"fg": loop, "cen": center}[mode](cdr3)
    total = sum((_count(part, a) * F.lit(float(v)) for a, v in values.items() if v), F.lit(0.0))
    return F.when(F.length(part) > 0, total / F.length(part)).otherwise(F.lit(sum(values.values()) / len(ALPHABET)))


def letter_fraction(letter: str) -> dict[str, float]:
    """The property whose mean is a letter's share."""
    return {letter: 1.0}


def cdr3_length(a: Column, b: Column) -> Column:
    return F.length(a) + 2 * F.length(b)


def trim_allele(gene: Column) -> Column:
    return F.substring_index(gene, "*", 1)


def locus_distance(va: Column, ja: Column, v_order: list[str], j_order: list[str]) -> Column:
    """Places of V genes from the locus' end plus those of J genes from its start; an unknown gene is half way."""
    place = lambda g, order: F.array_position(F.array(*map(F.lit, order)), trim_allele(g)) - 1
    v, j = place(va, v_order), place(ja, j_order)
    far_v = F.when(v >= 0, F.lit(len(v_order) - 1) - v).otherwise(F.lit(0.5 * (len(v_order) - 1)))
    return far_v.cast("double") + F.when(j >= 0, j).otherwise(F.lit(0.5 * (len(j_order) - 1))).cast("double")


def linear_model(cdr3a: Column, cdr3b: Column, rows: list[dict], properties: dict[str, dict[str, float]]) -> Column:
    """Sum of coefficients times standardised features, plus an intercept, over trimmed loops.

    A row is (feature, mean, var, coef, intercept); features are ``len``, a letter and ``frac``,
    ``arofrac`` or a property, each with the suffix _A, _B or _AB. Rows of no weight (1e-6) are left
    out; properties sum over the chains, an empty loop counting zero.
    """
    out = F.lit(float(rows[0]["intercept"]) if rows else 0.0)
    for r in rows:
        if abs(r["coef"]) <= 1e-6:
            continue
        tag, chains = r["feature"].rsplit("_", 1)
        loops = [loop({"A": cdr3a, "B": cdr3b}[c]) for c in chains]
        size = sum((F.length(x) for x in loops), F.lit(0))
        share = lambda letters, loops=loops, size=size: sum((_count(x, a) for x in loops for a in letters), F.lit(0)) / F.greatest(size, F.lit(1))
        if tag == "len":
            x = size.cast("double")
        elif tag == "arofrac":
            x = share("FYWH")
        elif tag[1:] == "frac" and tag[0] in ALPHABET:
            x = share(tag[0])
        else:
            x = sum((F.when(F.length(p) > 0, sum((_count(p, a) * F.lit(float(v)) for a, v in properties[tag].items() if v), F.lit(0.0)) / F.length(p)).otherwise(0.0) for p in loops), F.lit(0.0))
        out = out + F.lit(float(r["coef"])) * (x - F.lit(float(r["mean"]))) / F.sqrt(F.lit(float(r["var"])))
    return out


def logistic_chain(v: Column, j: Column, cdr3: Column, model: dict) -> Column:
    """Logit of one chain: weights of its V and J gene (or unknown), its length within bounds, the letters
    of a window at each end, the letters between by count, and a bias.

    ``model`` has v_genes, j_genes, min_len, max_len, window and weights in that order; windows of
    short CDR3s take half of it each, the first one less if it's odd.
    """
    vs, js, w, lo, hi, weights = model["v_genes"], model["j_genes"], model["window"], model["min_len"], model["max_len"], model["weights"]
    table = F.array(*[F.lit(float(x)) for x in weights])
    nv, nj, nl = len(vs) + 1, len(js) + 1, hi - lo + 1
    at = lambda k: F.element_at(table, k.cast("int") + 1)

    def gene(g, names):
        p = F.array_position(F.array(*map(F.lit, names)), trim_allele(g))
        return F.when(p > 0, p - 1).otherwise(F.lit(len(names)))

    out = at(gene(v, vs)) + at(gene(j, js) + nv) + at(F.least(F.greatest(F.length(cdr3), F.lit(lo)), F.lit(hi)) - lo + nv + nj)
    base, n = nv + nj + nl, F.length(cdr3)
    head = F.least(F.lit(w), F.floor(n / 2))
    tail = F.least(F.lit(w), n - head)
    place = lambda c: F.array_position(F.array(*map(F.lit, ALPHABET)), c) - 1
    for i in range(w):
        out = out + F.when(F.lit(i) < head, at(place(F.substring(cdr3, F.lit(i + 1), F.lit(1))) + base + 20 * i)).otherwise(0.0)
        out = out + F.when(F.lit(i) < tail, at(place(F.substring(cdr3, (n - i).cast("int"), F.lit(1))) + base + 20 * w + 20 * i)).otherwise(0.0)
    middle = F.substring(cdr3, (head + 1).cast("int"), F.greatest(n - head - tail, F.lit(0)).cast("int"))
    between = sum((_count(middle, a) * F.lit(float(weights[base + 40 * w + k])) for k, a in enumerate(ALPHABET)), F.lit(0.0))
    return out + between + F.lit(float(weights[-1]))


def logistic_score(a: Column, b: Column, sigmoid: bool = False) -> Column:
    """Mean of two chains' logits, or of their probabilities."""
    if sigmoid:
        a, b = 1 / (1 + F.exp(-a)), 1 / (1 + F.exp(-b))
    return 0.5 * (a + b)


def lookup_score(v: Column, j: Column, cdr3: Column, genes: dict[str, float], lengths: dict[int, float], letters: dict[str, float]) -> Column:
    """Sum of a chain's enrichments: V and J gene (0 if unknown), length within the table's bounds, and
    each letter of the loop of CDR3s longer than eight."""
    table = F.create_map(*[F.lit(x) for kv in genes.items() for x in kv]) if genes else F.create_map()
    of = lambda g: F.coalesce(F.try_element_at(table, trim_allele(g)), F.lit(0.0))
    n = F.least(F.greatest(F.length(cdr3), F.lit(min(lengths))), F.lit(max(lengths)))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), n)
    part = loop(cdr3)
    return of(v) + of(j) + size + F.when(n > 2 * TRIM, sum((_count(part, a) * F.lit(float(x)) for a, x in letters.items()), F.lit(0.0))).otherwise(0.0)



def strong_loop(cdr3: Column) -> Column:
    """An older hand-weighted loop score; none for CDR3s of eight letters or fewer."""
    part = loop(cdr3)
    c = lambda a: _count(part, a)
    value = F.length(part) + 3.0 * c("C") + 2.0 * c("W") + c("R") + c("K") + 0.5 * c("H") - c("D") - c("E")
    return F.when(F.length(cdr3) <= 2 * TRIM, 0.0).otherwise(value)


def is_mait(va: Column, ja: Column, cdr3a: Column, organism: str = "human") -> Column:
    """The invariant alpha chain of MAIT cells; a rhesus receptor goes by the human rule."""
    if "mouse" in organism:
        return va.startswith("TRAV1*") & ja.startswith("TRAJ33") & (F.length(cdr3a) == 12)
    return va.startswith("TRAV1-2") & (ja.startswith("TRAJ33") | ja.startswith("TRAJ20") | ja.startswith("TRAJ12")) & (F.length(cdr3a) == 12)


def is_inkt(va: Column, ja: Column, cdr3a: Column, vb: Column, organism: str = "human") -> Column:
    if "mouse" in organism:
        return va.startswith("TRAV11") & ja.startswith("TRAJ18") & (F.length(cdr3a) == 15)
    return va.startswith("TRAV10") & ja.startswith("TRAJ18") & F.length(cdr3a).between(14, 16) & vb.startswith("TRBV25")


def is_invariant(va: Column, ja: Column, cdr3a: Column, vb: Column, organism: str = "human", legacy_organism_branch: bool = False) -> Column:
    """MAIT or iNKT; with ``legacy_organism_branch`` the human rules for any organism."""
    kind = "human" if legacy_organism_branch else organism
    return is_mait(va, ja, cdr3a, kind) | is_inkt(va, ja, cdr3a, vb, kind)


def score_column(name: str, properties: dict[str, dict[str, float]], organism: str = "human", columns: tuple[str, ...] = (), models: dict | None = None) -> Column:
    """A named score of receptors (va, ja, cdr3a, vb, jb, cdr3b, ct).

    Names: cdr3len, tcr_cluster<n>, alphadist, cd8, imhc, old_imhc, mait, inkt, nndists_tcr and N_ins
    (zero where the table has no such column), a gene or a gene without its allele, or a property with
    _fg or _cen. ``models`` holds what alphadist, cd8 and imhc need.
    """
    c, models = F.col, models or {}
    if name == "cdr3len":
        return cdr3_length(c("cdr3a"), c("cdr3b")).cast("double")
    if name.startswith("tcr_cluster"):
        return (c("ct") == int(name.removeprefix("tcr_cluster"))).cast("double")
    if name == "alphadist":
        return locus_distance(c("va"), c("ja"), *models["alphadist"])
    if name == "cd8":
        return logistic_score(*(logistic_chain(c(f"v{x}"), c(f"j{x}"), c(f"cdr3{x}"), models["cd8"][x]) for x in "ab"))
    if name == "imhc":
        return linear_model(c("cdr3a"), c("cdr3b"), models["imhc"], properties)
    if name == "old_imhc":
        return (strong_loop(c("cdr3a")) + 2 * strong_loop(c("cdr3b"))).cast("double")
    if name == "mait":
        return is_mait(c("va"), c("ja"), c("cdr3a"), organism).cast("double")
    if name == "inkt":
        return is_inkt(c("va"), c("ja"), c("cdr3a"), c("vb"), organism).cast("double")
    if name in ("nndists_tcr", "N_ins"):
        return c(name).cast("double") if name in columns else F.lit(0.0)
    if name[:2] in ("TR", "IG"):
        slot = c({"AV": "va", "AJ": "ja", "BV": "vb", "BJ": "jb"}[name[2:4]])
        return ((slot if "*" in name else trim_allele(slot)) == name).cast("double")
    stem, mode = (name.rsplit("_", 1)[0], name.rsplit("_", 1)[1]) if name.rsplit("_", 1)[-1] in ("fg", "cen") else (name, "fg")
    values = letter_fraction(stem[0]) if stem[1:] == "_frac" and stem[0] in ALPHABET else properties[stem]
    return property_score(c("cdr3a"), values, mode) + property_score(c("cdr3b"), values, mode)


# ---- strings -----------------------------------------------------------------------------------
#: The standard genetic code, amino acids by codon in the order of TCAG.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Nucleotide symbols and the bases they stand for.
SYMBOLS = {"a": "a", "c": "c", "g": "g", "t": "t", "w": "at", "s": "cg", "k": "gt", "m": "ac", "y": "ct", "r": "ag", "b": "cgt", "d": "agt", "h": "act", "v": "acg", "n": "acgt"}
GENETIC_CODE = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("tcag") for j, b in enumerate("tcag") for k, c in enumerate("tcag")}


def _degenerate_code() -> dict[str, str]:
    """Codons over all symbols that stand for one amino acid; others translate to X."""
    out = {}
    for a in SYMBOLS:
        for b in SYMBOLS:
            for c in SYMBOLS:
                found = {GENETIC_CODE[x + y + z] for x in SYMBOLS[a] for y in SYMBOLS[b] for z in SYMBOLS[c]}
                if len(found) == 1:
                    out[a + b + c] = found.pop()
    return out


def reverse_complement(seq: Column) -> Column:
    """Symbols of the other strand, read backwards; unknown signs stay."""
    return F.reverse(F.translate(F.lower(seq), "acgtwskmyrbdhvn", "tgcaswmkryvhdbn"))


def translate(seq: Column, frame: int = 1) -> Column:
    """Protein of a nucleotide sequence in frame 1, 2, 3 or, on the other strand, -1, -2, -3; a codon with
    '#' is '#', one that isn't settled is X, and bases short of a codon are left out."""
    s = F.lower(seq) if frame > 0 else reverse_complement(seq)
    skip = abs(frame) - 1
    n = F.floor((F.length(s) - skip) / 3).cast("int")
    code = F.create_map(*[F.lit(x) for kv in _degenerate_code().items() for x in kv])

    def residue(k):
        codon = F.substring(s, k * 3 + skip + 1, F.lit(3))
        return F.when(codon.contains("#"), "#").otherwise(F.coalesce(F.try_element_at(code, codon), F.lit("X")))

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), residue), "")).otherwise(F.lit(""))


def symbols_match(a: Column, b: Column) -> Column:
    """Whether two nucleotide symbols have a base in common."""
    sets = F.create_map(*[x for k, v in SYMBOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.arrays_overlap(F.try_element_at(sets, F.lower(a)), F.try_element_at(sets, F.lower(b))), F.lit(False))


def find_degenerate(short: Column, long_: Column) -> Column:
    """First 0-based place of a degenerate sequence in another, or -1; the last place counts too."""
    room = F.length(long_) - F.length(short)
    at = lambda s, k: F.substring(s, k, F.lit(1))
    fits = lambda p: F.forall(F.sequence(F.lit(1), F.greatest(F.length(short), F.lit(1))), lambda k: symbols_match(at(short, k), at(long_, p + k)))
    found = F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), fits)
    return F.when((room < 0) | (F.length(short) == 0), F.when(F.length(short) == 0, 0).otherwise(-1)).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(-1)))


def significance(p: Column, scale: float = 1.0) -> Column:
    """Root of minus log10 of a p-value, none above one, scaled: the size of a mark."""
    return scale * F.sqrt(F.greatest(F.lit(0.0), -F.log10(F.greatest(p, F.lit(1e-300)))))
