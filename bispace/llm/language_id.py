"""Operator 6 - language identification with interpolated Kneser-Ney character models.

Each language has a character model of ``ORDER`` letters over words (lower-cased runs of letters,
with a mark before and after). Discounted probabilities and back-off weights of all n-grams are
kept in arrays sorted by n-gram hash and met by binary search. A text goes to the language with the
lowest cross-entropy per character; whole texts are scored, word by word, and the scores of words
met before come from a bounded cache per worker.

Rejection is calibrated on labelled rows kept out of the counts: a text is rejected if its
cross-entropy lies further above its language's mean than ``reject_z`` times the deviation of texts
plus that of single characters over the root of the text's length, or if it has no letter (Unicode category L). More than ``MOST_LABELS`` labels raise an error: each
one is a model that the driver builds and every worker holds.

The models are fitted on a sample bounded by ``rows_per_language`` expected labelled rows of each
language (half as many again for calibration), chosen by a hash of id and text, so that rows with
null ids are chosen one by one; predictions cover all rows. ``score`` is the share of the chosen
language in the likelihoods of all, those of longer texts taken to the power 30 / characters: it
tells close languages apart and doesn't run to 1 with a text's length.

Defined cases: null, empty and letterless texts get ``und``, score 0 and are rejected; rows map one
for one (ties, repeats, null ids stay); labels that are null are not learned; without any label
every text is ``und``; an empty table gives an empty one; extra columns pass through, those named as
an added column are replaced. Ties between languages go to the first by name.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import Shared, broadcast_key, ddl, mix64, tidy, worker_state

ORDER, ALPHABET, CACHE_ENTRIES, LONGEST_KEPT, WORDS_AT_ONCE, MOST_LABELS = 4, 65_536, 400_000, 64, 8_000, 1_000
_LETTERS = regex.compile(r"\p{L}+")  # by category: numerals such as a half, a raised two or a Roman eight are no letters
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1..ORDER-grams that end at each predicted character of words, 0 where the
    n-gram would reach before the word's opening mark; and each character's word number."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    opening = codes == 2
    word = np.cumsum(opening) - 1
    since = np.arange(len(codes)) - np.flatnonzero(opening)[word] if len(codes) else np.zeros(0, np.int64)
    grams, acc = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for n in range(ORDER):
            acc = acc.copy()
            acc[n:] += mix64(codes[: len(codes) - n] + _FOLD) * power if n else mix64(codes + _FOLD)
            power = power * np.uint64(0xD1342543DE82EF95)
            grams.append(np.where(since >= n, mix64(acc + np.uint64(n + 1)) | np.uint64(1), np.uint64(0)))
    return grams, np.where(opening, -1, word)


def _histories(grams: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of each n-gram's first n-1 characters: the (n-1)-gram that ends one place before."""
    return [np.concatenate([[np.uint64(0)], g])[:-1] for g in grams]


class Model:
    """Sorted hash arrays of one language: discounted probability by n-gram, weight by history."""

    def __init__(self, words: list[str], counts: list[int]):
        grams, word = _grams(words)
        histories = _histories(grams)
        inside = word >= 0
        weight = np.array(counts, np.float64)[word[inside]] if len(words) else np.zeros(0)
        self.levels = []
        above: np.ndarray | None = None
        for n in range(ORDER, 0, -1):
            here = grams[n - 1][inside]
            lower = grams[n - 2][inside] if n > 1 else np.ones(len(here), np.uint64)
            history = histories[n - 2][inside] if n > 1 else np.ones(len(here), np.uint64)
            use = here != 0
            # n-grams that start a word keep their own counts: nothing can stand before them
            keys, first, inverse = np.unique(here[use], return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight[use], len(keys))
            if above is not None:
                spread = np.zeros(len(keys))
                place = np.searchsorted(keys, above)
                np.add.at(spread, place, 1)
                count = np.where(spread > 0, spread, count)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.9))
            of = history[use][first]
            heads, at = np.unique(of, return_inverse=True)
            total = np.bincount(at, count, len(heads))
            kinds = np.bincount(at, minlength=len(heads))
            self.levels.append((keys, np.maximum(count - discount, 0) / np.maximum(total[at], 1), heads, discount * kinds / np.maximum(total, 1)))
            above = lower[use][first]  # one entry per kind of n-gram: counts what stands before
        self.levels.reverse()

    def log_p(self, grams: list[np.ndarray], histories: list[np.ndarray]) -> np.ndarray:
        """Natural log of each character's interpolated probability."""
        p = np.full(len(grams[0]), 1.0 / ALPHABET)
        for n, (keys, own, heads, back) in enumerate(self.levels, 1):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, grams[n - 1]), len(keys) - 1)
            h = histories[n - 2] if n > 1 else np.ones(len(p), np.uint64)
            to = np.minimum(np.searchsorted(heads, h), len(heads) - 1)
            known = (heads[to] == h) & (grams[n - 1] != 0)
            p = np.where(known, np.where(keys[at] == grams[n - 1], own[at], 0) + back[to] * p, p)
        return np.log(p)


class Scorer:
    """Scores by language; the models' languages are sorted by name."""

    def __init__(self, models: dict[str, Model], limits: dict[str, tuple[float, float, float]] | None = None):
        self.names, self.models, self.limits = sorted(models), models, limits or {}
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(models) + 1))

    def words(self, pieces: list[str]) -> np.ndarray:
        """For each piece of text: characters, and log probability by language."""
        found = [_LETTERS.findall(p.lower()) for p in pieces]
        grams, word = _grams([w for ws in found for w in ws])
        histories, inside = _histories(grams), word >= 0
        owner = np.repeat(np.arange(len(pieces)), [len(ws) for ws in found])[word[inside]] if inside.any() else np.zeros(0, np.int64)
        out = np.zeros((len(pieces), len(self.names) + 1))
        out[:, 0] = np.bincount(owner, minlength=len(pieces))
        grams, histories = [g[inside] for g in grams], [h[inside] for h in histories]
        for k, name in enumerate(self.names):
            out[:, k + 1] = np.bincount(owner, self.models[name].log_p(grams, histories), len(pieces))
        return out

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Sums of words() over each whole text."""
        split = [(t or "").split() for t in texts]
        seen = set().union(*split) if split else set()
        new = list(seen - self.rows.keys())
        at = len(self.rows)
        while len(self.table) < at + len(new):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k in range(0, len(new), WORDS_AT_ONCE):
            self.table[at + k : at + min(k + WORDS_AT_ONCE, len(new))] = self.words(new[k : k + WORDS_AT_ONCE])
        self.rows |= zip(new, range(at, at + len(new)), strict=True)
        get = self.rows.__getitem__
        out = np.array([self.table[list(map(get, pieces))].sum(0) if pieces else np.zeros(len(self.names) + 1) for pieces in split]).reshape(len(texts), -1)
        if len(self.rows) > CACHE_ENTRIES or any(len(p) > LONGEST_KEPT for p in new):
            stay = [p for p in (seen.difference(new) if len(self.rows) > CACHE_ENTRIES else self.rows) if len(p) <= LONGEST_KEPT]
            self.table[: len(stay)] = self.table[[get(p) for p in stay]] if stay else 0
            self.rows = dict(zip(stay, range(len(stay)), strict=True))
        return out

    def decide(self, sums: np.ndarray) -> tuple[list[str], list[float], list[bool], list[float | None]]:
        names, scores, rejected, entropies = [], [], [], []
        for row in sums:
            n = row[0]
            if not n or not self.names:
                names.append("und"), scores.append(0.0), rejected.append(True), entropies.append(None)
                continue
            entropy = -row[1:] / n
            k = int(np.argmin(entropy))
            odds = np.exp(-(entropy - entropy[k]) * min(n, 30))
            mean, text_sd, char_sd = self.limits.get(self.names[k], (math.inf, 0, 0))
            names.append(self.names[k]), scores.append(float(1 / odds.sum())), entropies.append(float(entropy[k]))
            rejected.append(bool(entropy[k] > mean + text_sd + char_sd / math.sqrt(n)))
        return names, scores, rejected, entropies


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows_per_language: int = 400, reject_z: float = 12.0) -> Scorer:
    """Models of all labels of ``labelled``. The driver gets each sampled word's count and three
    numbers per calibration row; both are bounded with the sample."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*")).limit(MOST_LABELS + 1).collect()}
    if not n:
        return Scorer({})
    if len(n) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {lang}")
    share = F.create_map(*[F.lit(x) for l, c in n.items() for x in (l, min(1.0, 1.5 * rows_per_language / c))])
    place = (F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text), F.lit("language sample")), F.lit(1_000_003)) / 1_000_003) / share[F.col(lang)]
    chosen = rows.select(F.col(lang).alias("l"), F.col(text).alias("t"), place.alias("at")).where("at < 1")

    def count(batches):
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for l, t in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for w in _LETTERS.findall(t.lower()):
                    seen[l, w] = seen.get((l, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["l", "w", "n"])

    words: dict[str, tuple[list, list]] = {l: ([], []) for l in n}
    # a language with few rows also learns from its calibration rows
    counted = chosen.where((F.col("at") < 2 / 3) | F.col("l").isin([l for l, c in n.items() if c < 30])).mapInArrow(count, "l string, w string, n long")
    for r in counted.groupBy("l", "w").agg(F.sum("n").alias("n")).collect():
        words[r["l"]][0].append(r["w"]), words[r["l"]][1].append(r["n"])
    scorer = Scorer({l: Model(*(list(x) for x in zip(*sorted(zip(w, c, strict=True)), strict=True))) for l, (w, c) in words.items() if w})
    sent = Shared(labelled.sparkSession, scorer)

    def measure(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "t"):
                sums = own.texts(part.column("t").to_pylist())
                k = [own.names.index(l) + 1 if l in own.names else 0 for l in part.column("l").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("l"), pa.array(sums[:, 0]), pa.array(sums[np.arange(len(k)), k])], names=["l", "n", "s"])

    by: dict[str, list] = {}
    for r in chosen.where("at >= 2 / 3").mapInArrow(measure, "l string, n double, s double").where("n > 0").collect():
        by.setdefault(r["l"], []).append((r["n"], -r["s"] / r["n"]))
    for l, found in by.items():
        sizes, entropy = np.array(found).T
        mean = float(np.average(entropy, weights=sizes))
        # spread between texts and between characters, by least squares of squared distances
        fit_to = np.stack([np.ones(len(sizes)), 1 / sizes], 1)
        text_var, char_var = np.maximum(np.linalg.lstsq(fit_to, (entropy - mean) ** 2, rcond=None)[0], [1e-4, 1.0])
        scorer.limits[l] = (mean, reject_z * math.sqrt(text_var), reject_z * math.sqrt(char_var))
    scorer.rows, scorer.table = {}, np.zeros((1024, len(scorer.names) + 1))
    return scorer


def identify(documents: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` (0 to 1), ``rejected`` and ``entropy`` (nats a character)."""
    sent = Shared(documents.sparkSession, scorer)
    keep = [c for c in documents.columns if c not in {"lang_pred", "score", "rejected", "entropy"}]

    def run(batches):
        gc.disable()
        own = worker_state(broadcast_key("language", sent), lambda: sent.value)
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                names, scores, rejected, entropy = own.decide(own.texts(batch.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropy, pa.float64())], names=[*keep, "lang_pred", "score", "rejected", "entropy"])

    source = documents.select(*dict.fromkeys([*keep, text]))
    extra = "lang_pred string, score double, rejected boolean, entropy double"
    return source.mapInArrow(tidy(run), ", ".join(x for x in (ddl(documents, keep), extra) if x)).select(*keep, "lang_pred", "score", "rejected", "entropy")
