"""Operator 9 - language-model scores by subword lattice likelihood.

The pieces of an existing vocabulary weigh all segmentations of a word: its probability is the sum
over them of the product of their pieces' probabilities, by a forward recursion in log space; a
text's is the product over its words and its end. Characters outside the vocabulary pass through
byte pieces, so every text has a finite score.

The scores in the vocabulary's file are ranks of merges, no log probabilities, so unigram
probabilities are fitted here: expected counts of pieces over all segmentations of all training
words (forward and backward recursions, ``EM_ROUNDS`` rounds, from the counts of the library's own
cuts), add-alpha smoothed. Word counts cover the whole training corpus.

``mixture_score``, an extra, gives each word met in training one arc more, from its start to its
end, with its relative frequency; the arcs of pieces then share the mass that Witten and Bell leave
to new words, V / (N + V).

Beside them stands an add-one word model. Counts of frequent words (``table_size`` at most, found
by a cut-off from the histogram of counts) are broadcast; the rarer words of documents meet the rest
of the counts in one join, pre-aggregated by document, so no table that grows with the corpus is
broadcast or sent to the driver, and hot words are never shuffled.

Defined cases: null and empty texts are their end token alone; rows map one for one (ties,
repeats, null ids stay; a null id counts as the empty text for the split); without training rows
all counts are zero; an empty table gives an empty one; columns of other names are ignored.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bispace.llm.bpe import slices
from bispace.llm.common import Shared, broadcast_key, crc_mod, file_broadcast, frequency_class, least_class, mix64, worker_state
from bispace.session import work_table

HELD_WORDS, ALPHA, EM_ROUNDS = 300_000, 0.1, 1
#: Words of up to so many characters are met together, so many at once.
LONGEST_TOGETHER, TOGETHER = 48, 2_048
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased; bytes.split() cuts at exactly space and \\t-\\r."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of each text counts as the empty word."""

    def run(batches):
        gc.disable()
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for t in batch.column("text").to_pylist():
                    held.update(words_of(t))
                    held[END] += 1
                if len(held) > HELD_WORDS:
                    # frequent words stay, the many rare ones go on
                    rare = Counter({w: n for w, n in held.items() if n < 8})
                    for w in rare:
                        del held[w]
                    held, rare = rare, held
                    yield out()
                    held = rare
        yield out()

    return documents.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Pieces:
    """Vocabulary of a sentencepiece file with the probabilities of its pieces."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.library.get_piece_size()

    def count(self, words: list[bytes], counts: list[int]) -> np.ndarray:
        total = np.zeros(self.size + 1)
        known = [(w.decode("utf-8", "replace"), n) for w, n in zip(words, counts, strict=True) if w]
        for ids, (_, n) in zip(self.library.encode([w for w, _ in known], num_threads=1), known, strict=True):
            for i in ids:
                total[i] += n
        total[self.size] = sum(n for w, n in zip(words, counts, strict=True) if not w)
        return total


def _hashes(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all runs of 1..``longest`` characters of texts of one length, by run length and start."""
    out, acc = [], np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(longest):
            acc = acc[:, :-1] * np.uint64(0x9FB21C651E98DF25) + codes[:, k:] + np.uint64(0x9E3779B97F4A7C15)
            out.append(mix64(acc + np.uint64(k)))
    return out


class Lattice:
    """Marginal probabilities of words under piece counts; ``end`` is that of a text's end."""

    def __init__(self, data: bytes, counts: np.ndarray):
        library = Pieces(data).library
        total = math.log(counts.sum() + ALPHA * len(counts))
        log_p = (np.log(counts + ALPHA) - total).tolist()
        self.size, self.end = len(counts) - 1, log_p[-1] / math.log(10)
        self.pieces: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.bytes, self.byte_number = [0.0] * 256, [0] * 256
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.bytes[int(piece[3:5], 16)], self.byte_number[int(piece[3:5], 16)] = log_p[i], i
            elif not library.is_control(i) and not library.is_unknown(i):
                self.pieces[piece], self.number[piece] = log_p[i], i
        self.longest: dict[str, int] = {}
        for p in self.pieces:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        # pieces as sorted hashes, for many words at once
        names = list(self.pieces)
        found = np.array([_hashes(np.array([[ord(c) for c in p]], np.uint64), len(p))[-1][0, 0] for p in names], np.uint64)
        order = np.argsort(found)
        self.hash, self.piece, self.log_p = found[order], np.array([self.number[p] for p in names])[order], np.array([self.pieces[p] for p in names])[order]
        self.there = np.zeros(1 << 20, bool)
        self.there[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.most = max(map(len, names))

    def _arcs(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For texts of one length: log p and number (-1: none) of the piece at each place, by the piece's
        length; a character without a piece has its bytes' and the number -2."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
        out = []
        for h in _hashes(codes.astype(np.uint64), min(self.most, codes.shape[1])):
            p, number = np.full(h.shape, -np.inf), np.full(h.shape, -1, np.int32)
            near = np.nonzero(self.there[(h >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hash, h[near]), len(self.hash) - 1)
            hit = self.hash[at] == h[near]
            near, at = (near[0][hit], near[1][hit]), at[hit]
            p[near], number[near] = self.log_p[at], self.piece[at]
            out.append((p, number))
        p, number = out[0]
        for code in np.unique(codes[number < 0]).tolist():
            lone = (codes == code) & (number < 0)
            p[lone], number[lone] = sum(self.bytes[b] for b in chr(code).encode("utf-8", "replace")), -2
        return out

    @staticmethod
    def _ahead(arcs: list, size: int) -> np.ndarray:
        ahead = np.full((len(arcs[0][0]), size + 1), -np.inf)
        ahead[:, 0] = 0
        for end in range(1, size + 1):
            for k in range(1, min(len(arcs), end) + 1):
                p = arcs[k - 1][0][:, end - k]
                ahead[:, end] = np.logaddexp(ahead[:, end], ahead[:, end - k] + p)
        return ahead

    def _by_length(self, raws: list[bytes]):
        """Numbers and texts of words of one length, few enough to be held; long words one by one."""
        sizes: dict[int, list[int]] = {}
        texts = ["▁" + r.decode("utf-8", "replace") for r in raws]
        for k, t in enumerate(texts):
            sizes.setdefault(len(t), []).append(k)
        for size, at in sizes.items():
            step = 1 if size > LONGEST_TOGETHER else TOGETHER
            for k in range(0, len(at), step):
                yield size, at[k : k + step], [texts[i] for i in at[k : k + step]]

    def words(self, raws: list[bytes]) -> np.ndarray:
        """log10 of the summed probability of all segmentations of each word with its opening space."""
        out = np.zeros(len(raws))
        with np.errstate(invalid="ignore"):
            for size, at, texts in self._by_length(raws):
                out[at] = self._ahead(self._arcs(texts), size)[:, -1] / math.log(10) if size <= LONGEST_TOGETHER else self.word(raws[at[0]])
        return out

    def expected(self, raws: list[bytes], counts: list[int]) -> np.ndarray:
        """Expected counts of pieces over all segmentations of words that occur ``counts`` times."""
        into, n = np.zeros(self.size + 1), np.array(counts, np.float64)
        with np.errstate(invalid="ignore"):
            for size, at, texts in self._by_length(raws):
                if size > LONGEST_TOGETHER:
                    self.expect(raws[at[0]], counts[at[0]], into)
                    continue
                arcs = self._arcs(texts)
                ahead, share = self._ahead(arcs, size), np.zeros((len(at), size + 1))
                share[:, size] = n[at]
                for end in range(size, 0, -1):
                    for k in range(1, min(len(arcs), end) + 1):
                        p, number = (x[:, end - k] for x in arcs[k - 1])
                        some = np.flatnonzero(number != -1)
                        if not len(some):
                            continue
                        part = share[some, end] * np.exp(ahead[some, end - k] + p[some] - ahead[some, end])
                        share[some, end - k] += part
                        own = number[some] >= 0
                        into += np.bincount(number[some][own], part[own], len(into))
                        for i, x in zip(some[~own].tolist(), part[~own].tolist(), strict=True):
                            for b in texts[i][end - 1].encode("utf-8", "replace"):
                                into[self.byte_number[b]] += x
        return into

    def _forward(self, text: str) -> tuple[list[float], list[list[tuple[int, float]]]]:
        """Log of the summed probability of each prefix, and the arcs (start, log p) into each end."""
        ahead, arcs = [0.0], [[]]
        get, longest, exp, log = self.pieces.get, self.longest.get, math.exp, math.log
        for end in range(1, len(text) + 1):
            char, into = text[end - 1], []
            for start in range(max(0, end - longest(char, 0)), end):
                p = get(text[start:end])
                if p is not None:
                    into.append((start, p))
            if char not in self.pieces:
                into.append((end - 1, sum(self.bytes[b] for b in char.encode("utf-8", "replace"))))
            arcs.append(into)
            if len(into) == 1:
                ahead.append(ahead[into[0][0]] + into[0][1])
            else:
                terms = [ahead[start] + p for start, p in into]
                top = max(terms)
                ahead.append(top + log(sum([exp(t - top) for t in terms])))
        return ahead, arcs

    def word(self, raw: bytes) -> float:
        """log10 of the summed probability of all segmentations of a word with its opening space."""
        return self._forward("▁" + raw.decode("utf-8", "replace"))[0][-1] / math.log(10)

    def expect(self, raw: bytes, n: float, into: np.ndarray) -> None:
        """Adds the expected counts of pieces in ``n`` occurrences of a word."""
        text = "▁" + raw.decode("utf-8", "replace")
        ahead, arcs = self._forward(text)
        exp = math.exp
        share = [0.0] * len(text) + [float(n)]  # expected visits of each place, from the end back
        for end in range(len(text), 0, -1):
            if share[end] == 0.0:
                continue
            for start, p in arcs[end]:
                part = share[end] * exp(ahead[start] + p - ahead[end])
                share[start] += part
                piece = self.number.get(text[start:end])
                if piece is not None:
                    into[piece] += part
                else:
                    for b in text[start:end].encode("utf-8", "replace"):
                        into[self.byte_number[b]] += part


class Scoring:
    """Frequent words with their scores, made once by the driver and the same in every worker."""

    def __init__(self, end: float, words: dict[bytes, tuple[int, float]], ends: int, total: int, kinds: int):
        below, new = math.log10(total + kinds + 1), kinds / (total + kinds) if kinds else 1.0
        self.rows = {w: k for k, w in enumerate(words)}
        self.values = np.zeros((len(words), 3))
        for w, (n, pieces) in words.items():
            self.values[self.rows[w]] = pieces, math.log10(n + 1) - below, math.log10((1 - new) * n / max(total, 1) + new * 10**pieces)
        self.end = (end, math.log10(ends + 1) - below, int(ends > 0))

    def text(self, text: str | None):
        """Tokens, known frequent tokens, their base score, score and mixture score; rarer words with counts."""
        words = words_of(text)
        at = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        known = at[at >= 0]
        score, base, mixture = self.values[known].sum(0).tolist()
        rare = Counter([words[k] for k in np.flatnonzero(at < 0).tolist()]) if len(known) < len(at) else {}
        return len(words) + 1, len(known) + self.end[2], base + self.end[1], score + self.end[0], mixture + self.end[0], rare


def score(documents: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2, table_size: int = 50_000, rounds: int = EM_ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixture_score) of every row."""
    spark = documents.sparkSession
    shared = file_broadcast(spark, path)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (crc_mod(F.col(doc_id), modulus) == held).alias("held_out"))
    counts = work_table(count_words(rows.where("not held_out").select("text")), "words")
    total, kinds, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("n"))), F.lit(0))).first()
    words = counts.where("length(word) > 0")
    size = Pieces(shared.value).size

    def pieces_of(cut) -> np.ndarray:
        """Sums over all training words of what ``cut(words, counts)`` makes of a batch; no more
        numbers than the vocabulary has pieces reach the driver."""

        def run(batches):
            gc.disable()
            sums = np.zeros(size + 1)
            for batch in batches:
                sums += cut(batch.column("word").to_pylist(), batch.column("n").to_pylist())
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "n"])

        found = np.zeros(size + 1)
        for r in words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            found[r["piece"]] = r["n"]
        found[size] = ends
        return found

    pieces = pieces_of(lambda w, n: worker_state(broadcast_key("pieces", shared), lambda: Pieces(shared.value)).count(w, n))
    for _ in range(rounds):
        sent = Shared(spark, pieces)

        def expected(w, n, sent=sent):
            return worker_state(broadcast_key("lattice", sent), lambda: Lattice(shared.value, sent.value)).expected(w, n)

        pieces = pieces_of(expected)
    counts_sent = Shared(spark, pieces)

    def of_frequent(batches):
        own = worker_state(broadcast_key("lattice", counts_sent), lambda: Lattice(shared.value, counts_sent.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(own.words(batch.column("word").to_pylist()))], names=["word", "n", "pieces"])

    top = words.where(frequency_class(F.col("n")) >= least_class(words, table_size)).mapInArrow(of_frequent, "word binary, n long, pieces double")
    frequent = Shared(spark, Scoring(Lattice(shared.value, pieces).end, {bytes(r["word"]): (r["n"], r["pieces"]) for r in top.collect()}, ends, total, kinds))
    schema = "doc_id {}, held_out boolean, n_tokens long, n_known long, base double, score double, mixture double, rare array<struct<word:binary,tf:int>>".format(dict(rows.dtypes)["doc_id"])
    pair = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def run(batches):
        gc.disable()
        own = worker_state(broadcast_key("frequent", frequent), lambda: frequent.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, known, base, found, mixture, rare = (list(x) for x in zip(*map(own.text, batch.column("text").to_pylist()), strict=True))
                flat = pa.StructArray.from_arrays([pa.array([w for ws in rare for w in ws], pa.binary()), pa.array([x for ws in rare for x in ws.values()], pa.int32())], names=["word", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32)), flat).cast(pair)
                made = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), *(pa.array(x, pa.float64()) for x in (base, found, mixture)), lists]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "mixture", "rare"])

    def by_pieces(batches):
        """Lattice scores of rare words; the join has brought equal words together, so each is
        scored about once on the whole cluster."""
        gc.disable()
        own = worker_state(broadcast_key("lattice", counts_sent), lambda: Lattice(shared.value, counts_sent.value))
        last: dict[bytes, float] = {}
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in last]
            last = {w: last[w] for w in words if w in last} | dict(zip(new, own.words(new).tolist(), strict=True))
            scores = np.array([last[w] for w in words])[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tf"), batch.column("n"), pa.array(scores, pa.float64())], names=["row", "tf", "n", "pieces"])

    done = work_table(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    new, most = (kinds / (total + kinds) if kinds else 1.0), math.log10(total + kinds + 1)
    rare = done.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    met = rare.join(counts.hint("merge"), "word", "left").select("word", "row", "tf", F.coalesce("n", F.lit(0)).alias("n")).mapInArrow(by_pieces, "row long, tf int, n long, pieces double")
    own = F.when(F.col("n") > 0, F.log10((1 - new) / max(total, 1) * F.col("n") + new * F.pow(F.lit(10.0), F.col("pieces")))).otherwise(F.col("pieces") + math.log10(new))
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).cast("long").alias("more"),
        F.sum((F.log10(F.col("n") + F.lit(1.0)) - most) * F.col("tf")).alias("add_base"),
        F.sum(F.col("pieces") * F.col("tf")).alias("add_score"),
        F.sum(own * F.col("tf")).alias("add_mixture"),
    )
    full = done.drop("rare").join(rest, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "add_base").alias("base_score"), plus("score", "add_score").alias("score"), plus("mixture", "add_mixture").alias("mixture_score"),
    )
