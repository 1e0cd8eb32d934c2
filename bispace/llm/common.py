"""Shared pieces of the text operators: packed text hashing and worker-side state."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {}


def release() -> None:
    """Drops a worker's state of earlier stages and gives its memory back to the system."""
    _STATE.clear()
    gc.collect()  # tasks may have left cycles while the collector was off
    trim()


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that trims the worker at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def worker_state(key, build: Callable):
    """Value kept in a Python worker (a model inflated from a broadcast) until a stage with another
    one runs there; no stage needs two, and workers outlive stages and jobs."""
    if key not in _STATE:
        release()
        _STATE[key] = build()
    return _STATE[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int):
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order.

    A word is a run of lower-cased ASCII letters, digits or non-ASCII characters; null and texts
    without words give an empty array. Work and memory are linear in the text.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[raw]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _POWERS.of(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text is one shingle; no words, none."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix64(acc)



def spread(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows from all over a table, all of a smaller one; chosen without a shuffle.

    Only for tables that tune speed or compressed size, never for a result.
    """
    n = df.count()
    return df if n <= rows else df.sample(False, rows / n, 7)


def frequency_class(n):
    """Eighths of powers of two: some hundred classes for any corpus."""
    return F.floor(F.log2(n) * 8).cast("int")


def least_class(counts: DataFrame, most: int) -> int:
    """The lowest frequency class of ``n`` from which up no more than ``most`` rows lie."""
    held, least = 0, 1 << 30
    for r in sorted(counts.groupBy(frequency_class(F.col("n")).alias("c")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["c"]):
        held += r["k"]
        if held > most:
            break
        least = r["c"]
    return least


def crc_mod(column, modulus: int):
    """crc32 of an id written as decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


class Shared:
    """A broadcast with a key of its own, so that a worker never takes another one's state for it."""

    def __init__(self, spark, value):
        self.key, self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._sent.value

    def drop(self) -> None:
        """Takes the value from the executors; a task that is run again fetches it anew."""
        self._sent.unpersist()


def file_broadcast(spark, path: str) -> Shared:
    """The bytes of a small local file (a tokenizer, a few MB); the path is the driver's."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: {len(data)} bytes; tokenizer files of at most 64 MB are broadcast")
    return Shared(spark, data)


def ddl(df: DataFrame, columns: list[str]) -> str:
    """Schema text of some columns of ``df``."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[f"`{c}`" for c in columns]).schema)


def broadcast_key(name: str, shared: Shared) -> tuple:
    return name, shared.key
