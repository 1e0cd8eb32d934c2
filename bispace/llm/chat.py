"""Operator 1 - chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant
texts are intersected with the sorted token spans by binary search.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` newline for each turn. Control strings inside
texts and roles are escaped reversibly: a run ``<``, any backslashes, ``|`` gets one more backslash,
so no text can hold ``<|``. Each text stands between two control strings, which are tokens of their
own, so no token crosses an end of a text and the loss mask covers whole texts exactly; what is read
back as text under the loss comes from the mask and the tokens' places alone.

Defined cases: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows
have one order and each repeated row is a turn of its own; null roles and texts are empty; rows of
a null conv_id form one conversation; an empty table gives no rows; other input columns are
ignored. A conversation is one row of the output, so it alone bounds a task's memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.llm.common import broadcast_key, file_broadcast, tidy, worker_state

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation and the character spans of the texts that bear loss."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation, as they were before it was rendered."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def align(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Token mask and, for each span, the characters of it that its tokens cover.

    Both lists are sorted; the tokens that meet a span lie between two binary searches. A token
    that crosses an end of a span bears loss, but only its part inside counts as covered.
    """
    starts, ends = np.asarray(offsets, np.int64).reshape(-1, 2).T
    mask, covered = np.zeros(len(offsets), np.int8), []
    for a, b in spans:
        first, after = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if a < b and first < after:
            mask[first:after] = 1
            covered.append((max(a, int(starts[first])), min(b, int(ends[after - 1]))))
    return mask, covered


def _tokenizer(data: bytes):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
    return tokenizer


SCHEMA = "conv_id long, formatted string, token_ids array<int>, token_starts array<int>, loss_mask array<tinyint>, loss_spans array<struct<start:long,end:long>>"


def _lists(rows: list, values: pa.Array | None = None) -> pa.ListArray:
    """An Arrow list column from arrays, or from their lengths and all their values."""
    values = pa.array(np.concatenate(rows)) if values is None else values
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), values)


def format_conversations(conversations: DataFrame, path: str, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text, token ids and their first characters, a loss mask
    over them, covered spans."""
    shared = file_broadcast(conversations.sparkSession, path)
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def run(batches):
        tokenizer = worker_state(broadcast_key("chat", shared), lambda: _tokenizer(shared.value))
        for batch in batches:
            for part in (batch.slice(k, 64) for k in range(0, batch.num_rows, 64)):
                turns = [[(t["role"] or "", t["text"] or "") for t in ts] for ts in part.column("turns").to_pylist()]
                texts, spans = zip(*(render(t, loss_role) for t in turns), strict=True)
                ids, starts, masks, covered = [], [], [], []
                for span, text in zip(spans, texts, strict=True):
                    encoded = tokenizer.encode(text, add_special_tokens=False)
                    offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
                    mask, cover = align(span, offsets)
                    ids.append(np.array(encoded.ids, np.int32)), starts.append(offsets[:, 0]), masks.append(mask), covered.append(cover)
                ends = np.array([x for c in covered for x in c], np.int64).reshape(-1, 2)
                pairs = pa.StructArray.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["start", "end"])
                columns = [part.column("conv_id"), pa.array(texts, pa.string()), *map(_lists, (ids, starts, masks)), _lists(covered, pairs)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "formatted", "token_ids", "token_starts", "loss_mask", "loss_spans"])

    return whole.mapInArrow(tidy(run), SCHEMA)


def under_loss(text: str, starts: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text of each run of masked tokens: from its first one to the token after it."""
    step = np.diff(mask, prepend=0, append=0)
    ends = np.append(starts, len(text))
    return "".join(unescape(text[ends[a] : ends[b]]) for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns array<struct<role,text>>`` from the formatted text, and ``loss_text`` from the
    tokens under the loss mask."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formatted.schema)
    pair = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
            places, masks = ([batch.column(c)[k].values.to_numpy(zero_copy_only=False) for k in range(batch.num_rows)] for c in ("token_starts", "loss_mask"))
            loss = [under_loss(*x) for x in zip(texts, places, masks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turns, pair), pa.array(loss, pa.string())], names=[*batch.schema.names, "turns", "loss_text"])

    return formatted.mapInArrow(tidy(run), f"{fields}, turns array<struct<role:string,text:string>>, loss_text string")
