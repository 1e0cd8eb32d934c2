"""Operator 5 - benchmark decontamination with spaced seeds.

Fixed masks select some of the word positions of a window and ignore the others, so a window still
hashes alike when an ignored word was substituted. Seed hashes of benchmark items and documents
are joined; around each hit the document is laid along the item on the hit's diagonal, and all its
ungapped stretches are verified word by word, substitutions allowed.

An item counts as leaked if one of them has at least ``min_words`` equal words (or ``similarity``
of the item's words where that is fewer) and at least ``similarity`` of its words are equal.

The benchmark is broadcast in slices of about ``slice_seeds`` seeds, counted before. One slice is
met where documents are read. Of more, each is a job of its own that keeps only the rows with leaks,
so driver and workers hold one slice at a time, and a benchmark of any size is searched whole.
A hot passage costs nothing extra: documents aren't shuffled.

Defined cases: null and wordless texts and items match nothing; items of fewer words than any mask
and than ``min_item`` aren't searched; items with a null id are searched, and their leaks have a null
id, which ``n_items`` counts as one item; rows map one for one
(ties, repeats and null ids stay); an empty benchmark marks nothing; an empty table gives an empty
one; extra columns pass through, those named as an added column are replaced.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import Shared, broadcast_key, ddl, mix64, word_hashes, worker_state
from bispace.session import work_table

#: Word positions that each mask compares.
MASKS = ("1110111", "11010111", "110110011", "101110011", "11110")
#: Items of fewer words get seeds of the run of equal words that any leak of them must hold.
SHORT = 16


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of the mask's length over the positions that the mask selects."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, used in enumerate(mask):
            if used == "1":
                acc = acc * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
        return mix64(acc + np.uint64(int(mask, 2)) * np.uint64(0xC2B2AE3D27D4EB4F))


def best_stretch(equal: np.ndarray, share: Fraction) -> tuple[int, int]:
    """Ends of the stretch with most equal words among all whose share of equal words is at least ``share``.

    An equal word scores ``1 - share`` and another ``-share``, in whole numbers; so a stretch has
    the share exactly if its score isn't negative, and of those that end at a word the one from the
    earliest start has most equal words. It starts and ends with equal ones.
    """
    score, n = np.zeros((2, len(equal) + 1), np.int64)
    np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator), out=score[1:])
    np.cumsum(equal, out=n[1:])
    first = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(n - n[first]))
    hits = np.flatnonzero(equal[first[end] : end]) + first[end]
    return (int(hits[0]), int(hits[-1]) + 1) if len(hits) else (0, 0)


class Index:
    """Seeds of a slice of the benchmark in one sorted array."""

    def __init__(self, items: list[tuple[int, bytes]], min_words: int, similarity: float, min_item: int):
        self.items = [(i, np.frombuffer(w, np.uint64)) for i, w in items]
        self.min_words, self.share = min_words, Fraction(str(similarity))
        found = []
        self.masks = dict.fromkeys(MASKS)
        for at, (_, words) in enumerate(self.items):
            own = [*MASKS]
            if min_item <= len(words) < SHORT:
                need = math.ceil(min(min_words, self.share * len(words)))
                own.append("1" * max(1, -(-need // (len(words) - need + 1))))
            self.masks |= dict.fromkeys(own)
            for mask in dict.fromkeys(own):
                s = seeds(words, mask)
                found.append((s, np.full(len(s), at), np.arange(len(s))))
        self.hash, self.item, self.at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order].astype(np.uint64), self.item[order], self.at[order]
        self.bits = max(16, int(np.ceil(np.log2(len(self.hash) * 16 + 1))))
        self.there = np.zeros(1 << self.bits, bool)
        self.there[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, first word, word after the last, equal words) of each leaked item."""
        diagonals = set()
        for mask in self.masks:
            s = seeds(words, mask)
            near = np.flatnonzero(self.there[(s >> np.uint64(64 - self.bits)).astype(np.int64)])
            if not len(near):
                continue
            low, high = np.searchsorted(self.hash, s[near], "left"), np.searchsorted(self.hash, s[near], "right")
            for p, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                diagonals.update(zip(self.item[a:b].tolist(), (p - self.at[a:b]).tolist(), strict=True))
        best: dict[int, tuple[int, int, int]] = {}
        for at, shift in diagonals:
            item = self.items[at][1]
            a, b = max(0, -shift), min(len(item), len(words) - shift)
            equal = words[a + shift : b + shift] == item[a:b]
            start, end = best_stretch(equal, self.share)
            n = int(equal[start:end].sum())
            if n and n >= min(self.min_words, self.share * len(item)):
                found = (n, a + shift + start, a + shift + end)
                best[at] = max(best.get(at, found), found)
        return [(self.items[at][0], a, b, n) for at, (n, a, b) in sorted(best.items())]


_LEAK = "leaks array<struct<item_id:long,first_word:long,end_word:long,equal_words:long>>"


def find_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 13, similarity: float = 0.8, min_item: int = 3, slice_seeds: int = 2_000_000) -> DataFrame:
    """``documents`` with ``leaks`` (one entry per leaked item, by item id), ``n_items`` and ``contaminated``."""
    spark = documents.sparkSession

    def hashed(batches):
        for batch in batches:
            words = [word_hashes(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([len(w) * (len(MASKS) + 1) for w in words], pa.int64())], names=["i", "w", "n"])

    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).mapInArrow(hashed, "i long, w binary, n long").where("n > 0")
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_slices = max(1, -(-int(total) // slice_seeds))
    keep = [c for c in documents.columns if c not in {"leaks", "n_items", "contaminated"}]
    source = documents.select(*dict.fromkeys([*keep, text]))
    pair = pa.list_(pa.struct([(k, pa.int64()) for k in ("item_id", "first_word", "end_word", "equal_words")]))

    def met(df: DataFrame, k: int, columns: list[str], all_rows: bool) -> tuple[DataFrame, Shared]:
        """``columns`` of ``df`` with the leaks of a slice; all rows, or those with any."""
        part = items if n_slices == 1 else items.where(F.pmod(F.xxhash64("i", "w"), F.lit(n_slices)) == k)
        sent = Shared(spark, [(r["i"], bytes(r["w"])) for r in part.select("i", "w").orderBy("i", "w").collect()])

        def run(batches):
            index = worker_state(broadcast_key("leaks", sent), lambda: Index(sent.value, min_words, similarity, min_item))
            for whole in batches:
                for batch in slices(whole, text):
                    found = [[{"item_id": i, "first_word": a, "end_word": b, "equal_words": n} for i, a, b, n in (index.search(word_hashes(t)) if index.items else [])] for t in batch.column(text).to_pylist()]
                    out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pair)], names=[*columns, "leaks"])
                    yield out if all_rows else out.filter(pa.array([bool(f) for f in found]))

        schema = ", ".join(x for x in (ddl(df, columns), _LEAK) if x)
        return df.mapInArrow(run, schema), sent

    if n_slices == 1:
        out = met(source, 0, source.columns, True)[0]
    else:
        row = "_row"
        while row in source.columns:
            row += "_"
        numbered = work_table(source.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = None
        for k in range(n_slices):
            hits, sent = met(numbered.select(row, text), k, [row], False)
            hits = work_table(hits, "leaks")
            sent.drop()
            found = hits if found is None else found.unionByName(hits)
        each = found.groupBy(row).agg(F.flatten(F.collect_list("leaks")).alias("leaks"))
        out = numbered.join(each, row, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(_LEAK.removeprefix("leaks "))))
    leaks = F.array_sort("leaks")
    return out.select(*keep, leaks.alias("leaks"), F.size(F.array_distinct("leaks.item_id")).cast("long").alias("n_items"), (F.size("leaks") > 0).alias("contaminated"))
