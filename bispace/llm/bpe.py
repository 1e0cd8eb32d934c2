"""Operator 3 - byte-pair encoding and decoding by a depth-first walk of a trie of distinct words.

The tokenization of a prefix is fixed by its last token: token ``t`` ends the encoding of a prefix
``p`` exactly if ``p`` ends with ``t`` and ``t`` may follow the last token of what precedes it.
Walking the trie of all new distinct words depth first therefore needs one last-token state per
node, and a prefix that many words share is encoded once. Encodings of space-led pieces of text are
kept by each worker within a fixed budget, so frequent words cost one dictionary look-up.

Null texts encode as empty texts (no ids, decoded as ''). Rows are kept one for one: repeated rows,
null ids and extra columns pass through untouched, and an empty table gives an empty table. Texts
are processed whole whatever their length. Two columns are added and replace any of the same name.
"""

from __future__ import annotations

import gc
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from bispace.llm.common import broadcast_key, file_broadcast, tidy, worker_state

#: The pre-tokenizer's pattern and White_Space, as the vocabulary's library has them.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Characters and entries of cached pieces per worker; beyond it only pieces that recur stay.
CACHE_CHARS, CACHE_ENTRIES = 24 << 20, 550_000


def byte_alphabet() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of a byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {s: i for s, i in vocab.items() if s not in self.special}
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in plain.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of = {self.bytes_of[i]: i for i in plain.values()}
        self.left, self.right, self.joined = {}, {}, {}
        first = 256
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            if made != first + k or vocab[a] >= made or vocab[b] >= made:
                raise ValueError("the vocabulary's ids don't follow the order of its merges")
            self.left[made], self.right[made], self.joined[vocab[a], vocab[b]] = vocab[a], vocab[b], made
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for raw, i in self.id_of.items():
            state = 0
            for byte in raw:
                state = self.step.setdefault(state << 8 | byte, len(self.ends))
                if state == len(self.ends):
                    self.ends.append(-1)
            self.ends[state] = i
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.pattern = regex.compile(PRETOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.follows: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}
        self.kept = 0

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding leaves a boundary between tokens a and b: undo their merges from the
        latest on; at no moment may the two pieces at the boundary have an earlier merge."""
        key = a << 20 | b
        known = self.follows.get(key)
        if known is not None:
            return known
        before, free = 1 << 60, True
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < before:
                free = False
                break
            if max(a, b) < 256:
                break
            if a > b:
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[key] = free
        return free

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids (little-endian 32 bit) of each word, by one depth-first walk of the words' trie.

        The trie is held as its leaves in order: the common prefix with the leaf before is the
        part of the path that stays, with its states; only nodes below it are new.
        """
        out: dict[str, bytes] = {}
        last, start, live, before = [0], [0], [()], b""
        step, ends, follows, packed = self.step.get, self.ends, self.follows.get, self.packed
        for raw, word in sorted([(w.encode(), w) for w in words]):
            shared, most = 0, min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], live[shared + 1 :]
            for at in range(shared, len(raw)):
                # states of the vocabulary's own trie for every start that may still become a token
                byte, found, now = raw[at], -1, []
                for state, begin in live[at]:
                    state = step(state << 8 | byte)
                    if state is not None:
                        now.append((state, begin))
                        if found < 0 and (token := ends[state]) >= 0:
                            if begin == 0:
                                found, first = token, 0
                            else:
                                a = last[begin]
                                fits = follows(a << 20 | token)
                                if fits if fits is not None else self.may_follow(a, token):
                                    found, first = token, begin
                state = step(byte)
                now.append((state, at))
                if found < 0:
                    found, first = ends[state], at
                last.append(found)
                start.append(first)
                live.append(now)
            ids, end = [], len(raw)
            while end:
                ids.append(packed[last[end]])
                end = start[end]
            ids.reverse()
            out[word] = b"".join(ids)
            before = raw
        return out

    def split(self, text: str) -> list[str | int]:
        """Words of a text by the pre-tokenizer, special strings as their ids."""
        if self.cut is None or "<|" not in text:
            return self.pattern.findall(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out += self.pattern.findall(part)
        return out

    def _of_words(self, split: list[list[str | int]]) -> list[bytes]:
        new = {w for words in split for w in words if w.__class__ is str} - self.words.keys()
        if new:
            self.words |= self.encode_words(new)
        get = self.words.__getitem__
        return [get(words[0]) if len(words) == 1 and words[0].__class__ is str else b"".join([get(w) if w.__class__ is str else self.packed[w] for w in words]) for words in split]

    def _piece(self, piece: str) -> list[str | int]:
        """Words of a space and a piece; letters, and letters with one mark after them, need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,!?;:" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.split(" " + piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers.

        A space before a character that isn't white always starts a word, so a text is cut at its
        spaces and pieces are looked up whole. A piece whose cut isn't certain (white space or a
        special string after the space) is marked None, and its text is split as a whole.
        """
        cut = [(t or "").split(" ") for t in texts]
        heads = {parts[0] for parts in cut}
        seen = set().union(*(parts[1:] for parts in cut)) if cut else set()
        new = seen - self.pieces.keys()
        marks = tuple(self.special)
        sure = [p for p in new if p and p[0] not in WHITE and not p.startswith(marks)]
        self.pieces |= dict.fromkeys(new)
        self.pieces |= zip(sure, self._of_words(list(map(self._piece, sure))), strict=True)
        first = dict(zip(heads, self._of_words([self.split(h) for h in heads]), strict=True))
        out, get = [], self.pieces.__getitem__
        for text, parts in zip(texts, cut, strict=True):
            try:
                out.append(b"".join([first[parts[0]], *map(get, parts[1:])]))
            except TypeError:
                out += self._of_words([self.split(text)])
        self.kept += sum(map(len, new))
        if self.kept > CACHE_CHARS or len(self.pieces) + len(self.words) > CACHE_ENTRIES:
            stay = seen - new if len(seen) < CACHE_ENTRIES else set()
            self.pieces, self.words, self.kept = {p: self.pieces[p] for p in stay}, {}, sum(map(len, stay))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD, special tokens their strings."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """Arrow lists of 32-bit ids from packed bytes, without a Python object per id."""
    ends = np.cumsum([0, *(len(e) // 4 for e in encoded)])
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids in one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def codec(broadcast) -> Codec:
    gc.disable()  # the walk makes many small objects and no cycles
    return worker_state(broadcast_key("bpe", broadcast), lambda: Codec(broadcast.value))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Parts of a batch with about ``most`` bytes of text each (one row at least): bounds memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)


def encode_decode(documents: DataFrame, path: str, text: str = "text", decode: bool = True, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``documents`` with ``token_ids array<int>`` and, if wanted, ``decoded string`` of whole texts."""
    shared = file_broadcast(documents.sparkSession, path)
    keep = [c for c in documents.columns if c not in {ids_col, decoded_col}]
    source = documents.select(*{*keep, text})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    fields = ", ".join(x for x in (fields, f"`{ids_col}` array<int>", f"`{decoded_col}` string" if decode else "") if x)

    def run(batches):
        own = codec(shared)
        for whole in batches:
            for batch in slices(whole, text, 4 << 20):
                ids = id_lists(own.encode(batch.column(text).to_pylist()))
                made = [ids]
                if decode:
                    flat, ends = ids.values.to_numpy(), ids.offsets.to_pylist()
                    made.append(pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, ids_col, *[decoded_col] * decode])

    return source.mapInArrow(tidy(run), fields)
