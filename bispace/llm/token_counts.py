"""Operator 4 - token counts by a two-tier map-side look-up; no pre-token is ever shuffled.

Tier one is a compact table of frequent pre-tokens and their token lengths, broadcast once. Tier
two is a cache in each worker for the pre-tokens that the table misses; those are encoded with the
tokenizer itself, so every count is the library's own. The table only decides what is looked up
fast: it is built from about ``sample_rows`` rows, drawn evenly from the whole table, and holds at
most ``table_size`` entries; counts don't depend on it.

Null texts count as empty (0 bytes, 0 tokens); rows map one for one, so ties, repeated rows and
extra columns pass through; an empty table gives an empty one; texts are counted whole. The added
columns replace any of the same name.
"""

from __future__ import annotations

import gc
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import Shared, broadcast_key, file_broadcast, frequency_class, least_class, spread, worker_state
from bispace.session import work_table

#: White space for Python's split() that the tokenizer doesn't hold as such.
_ODD = re.compile("[\x1c-\x1f]")
#: Pieces longer than this are encoded but not kept; beyond its budget a cache keeps what recurs.
LONGEST_KEPT, CACHE_ENTRIES = 64, 600_000


def _tokenizer(data: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def frequent_pieces(documents: DataFrame, text: str, table_size: int, sample_rows: int) -> list[str]:
    """Most frequent white-space pieces of about ``sample_rows`` rows from the whole table.

    Rows are chosen where they are read, so no text is shuffled; a cut-off from the histogram of
    counts keeps what reaches the driver within ``table_size`` pieces.
    """
    sample = spread(documents.select(text), sample_rows).where(F.col(text).isNotNull())

    def count(batches):
        seen = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(p for p in t.split() if len(p) <= LONGEST_KEPT)
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    counted = work_table(sample.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    return [r[0] for r in counted.where(frequency_class(F.col("n")) >= least_class(counted, table_size)).orderBy(F.desc("n"), "piece").collect()]


class FrequentTable:
    """Pieces as one joined text and their lengths as 16-bit numbers; inflated once per worker."""

    def __init__(self, pieces: list[str], lengths: list[int]):
        small = [(p, n) for p, n in zip(pieces, lengths, strict=True) if n < 1 << 16]
        self.text = "\n".join(p for p, _ in small)
        self.lengths = np.array([n for _, n in small], np.uint16)

    def inflate(self) -> dict[str, int]:
        return dict(zip(self.text.split("\n"), self.lengths.tolist(), strict=True)) if len(self.lengths) else {}


class Counting:
    def __init__(self, data: bytes, table: FrequentTable):
        self.tokenizer, self.frequent = _tokenizer(data), table.inflate()
        self.known = dict(self.frequent)  # tier one, then what this worker has met

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for k in range(0, len(pieces), 4096) for e in self.tokenizer.encode_batch(pieces[k : k + 4096], add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. White space never is part of a token and always ends one, so a
        text's count is the sum over its white-space pieces."""
        split = [(t or "").split() for t in texts]
        seen = set().union(*split) if split else set()
        missing = list(seen - self.known.keys())
        self.known |= zip(missing, self.encode(missing), strict=True)
        get = self.known.__getitem__
        out = [sum(map(get, pieces)) for pieces in split]
        for k, t in enumerate(texts):
            if t and _ODD.search(t):
                out[k] = self.encode([t])[0]
        for piece in [p for p in missing if len(p) > LONGEST_KEPT]:
            del self.known[piece]
        if len(self.known) > CACHE_ENTRIES:
            stay = seen.difference(missing)
            self.known = self.frequent | {p: get(p) for p in stay}
        return out


def count_tokens(documents: DataFrame, path: str, text: str = "text", limit: int = 2048, table_size: int = 50_000, sample_rows: int = 2_000) -> DataFrame:
    """``documents`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text."""
    spark = documents.sparkSession
    shared = file_broadcast(spark, path)
    pieces = frequent_pieces(documents, text, table_size, sample_rows)
    tokenizer = _tokenizer(shared.value)
    table = Shared(spark, FrequentTable(pieces, [len(e) for e in tokenizer.encode_batch(pieces, add_special_tokens=False)]))
    keep = [c for c in documents.columns if c not in {"n_bytes", "n_tokens", "over_limit"}]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def run(batches):
        own = worker_state(broadcast_key("counts", table), lambda: Counting(shared.value, table.value))
        gc.disable()
        for whole in batches:
            for batch in slices(whole, text):
                n = own.counts(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    counted = documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{fields}, n_tokens long")
    return counted.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
