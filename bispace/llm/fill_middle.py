"""Operator 12 - fill-in-middle rearrangement of whole texts on code point arrays.

Each text becomes a UTF-32 array of code points; the classes of neighbouring code points say where a
unit (a line, a word with the white space after it, or a code point) ends, the chosen ranks index
those ends, and the slices are encoded again behind sentinels. The cuts come from a hash of a seed
and the id, so a task that is run again, or another partitioning, gives the same rows.

Defined cases: a null text is an empty one and stays plain; so does a text that holds a sentinel, and
what the share leaves out; a null id hashes as an empty one; rows stay one for one, repeated ids get
equal draws; columns of the operator's own names are replaced, others pass through; an empty table
gives an empty one; a text of any length is one row, held as four bytes a code point while it is cut.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import ddl, tidy

SENTINELS = ("<P>", "<S>", "<M>")
_MADE = ["n", "form", "prefix_chars", "middle_chars", "output"]
_WHITE = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cuts(cp: np.ndarray, unit: str) -> np.ndarray:
    """Places where units end, 0 first: ``len(cuts) - 1`` units."""
    if not len(cp):
        return np.zeros(1, np.int64)
    if unit == "line":
        ends = cp[:-1] == 10
    elif unit == "word":
        white = np.isin(cp, _WHITE)
        ends = white[:-1] & ~white[1:]
    elif unit == "char":
        ends = np.ones(len(cp) - 1, bool)
    else:
        raise ValueError(f"unit {unit}: line, word or char")
    return np.concatenate([[0], np.flatnonzero(ends) + 1, [len(cp)]])


def draws(seed: int, key: str) -> list[int]:
    """Four integers of 32 bits from a seed and an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def arrange(text: str, h: list[int], unit: str, share: int, spm_share: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    cp = points(text)
    at = cuts(cp, unit)
    n = len(at) - 1
    if not n or h[2] % 100 >= share or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = int(at[first]), int(at[second])
    prefix, middle, suffix = (piece.tobytes().decode("utf-32-le", "surrogatepass") for piece in (cp[:a], cp[a:b], cp[b:]))
    p, s, m = sentinels
    if h[3] % 100 < spm_share:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(documents: DataFrame, seed: int = 7, share: int = 100, spm_share: int = 50, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``share`` of 100 texts are rearranged, ``spm_share`` of 100 of those with the suffix first.
    """
    if not all(sentinels) or len({s[0] for s in sentinels} & {s[-1] for s in sentinels}):
        raise ValueError("a sentinel must not be empty nor begin as one ends")
    if unit not in {"line", "word", "char"}:
        raise ValueError(f"unit {unit}: line, word or char")
    keep = [c for c in documents.columns if c not in _MADE]
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    source = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").alias("t"), key.alias("k"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                rows = [arrange(t or "", draws(seed, k), unit, share, spm_share, sentinels) for t, k in zip(batch.column("t").to_pylist(), batch.column("k").to_pylist(), strict=True)]
                made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *_MADE])

    fields = [ddl(documents, keep)] if keep else []
    return source.mapInArrow(tidy(run), ", ".join([*fields, "n long, form string, prefix_chars long, middle_chars long, output string"]))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form were made of."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), 4)  # what lies before the first sentinel is empty
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
