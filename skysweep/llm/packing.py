"""Mixture-controlled packing of token sequences by deficit round-robin over source queues.

A document is its ids by a public tokenizer and an end id. Sources are queues, in code-point order (null last); a queue is in the order of a
hash of the document. In every round (window) a queue's credit grows by its quantum and it serves as many whole ids as its credit allows; the fraction left is its
deficit, carried to the next window. A queue that is spent leaves its quantum to the queues that are not, by their weights, so that windows stay full. Quanta
follow the target proportions; by default these are the sources' shares of all ids, so that all queues end together.

In terms of a common clock, a queue of weight w has served floor(w * t) ids at the time t, or all of its ids; after k windows the clock is
where k windows' ids are served in all. Any task can so work out the windows of its own documents: windows and their deficits carry across partitions without
a walk through all windows.

The windows make one line of ids, which is cut into sequences of `length` ids. The last sequence is cut into powers of two, which need no padding.
Null texts are empty: their document is the end id. Rows that repeat an id are documents of their own; equal rows are interchangeable. Every source has
a queue of its own, however many there are: driver and tasks hold two numbers a source, and the time of a window grows with the sources. Other columns are not looked at.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import blocks, hashed_words, written

#: Sequences in a window; words whose ids a worker remembers; documents in a part of a queue.
WINDOW, REMEMBERED, PART = 32, 2_000_000, 4_000
_KNOWN: dict[tuple[str, int], Words] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, source, n, ids): ids as little-endian numbers of 2 bytes, or 4 if the vocabulary is larger.

    The tokenizer must not join words across ASCII blanks: words between them are looked up one by one, and remembered."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer or tokenizer_path()
        model = Tokenizer.from_file(path)
        kind = np.dtype("<u2") if max(model.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        words = _KNOWN.get((path, kind.itemsize)) or _KNOWN.setdefault((path, kind.itemsize), Words(kind, model))
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                hashes, starts, stops, counts = hashed_words(data, ends, False)
                ids, per_word = words.ids(model, data, hashes, starts, stops)
                total = np.concatenate(([0], np.cumsum(per_word)))[counts]
                ids = np.insert(ids, total, end_id)
                cuts = (np.concatenate(([0], total + np.arange(1, len(total) + 1))) * kind.itemsize).astype(np.int32)
                n = np.diff(cuts) // kind.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids.astype(kind))])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "source": batch.column("source").slice(a, b - a), "n": pa.array(n, pa.int64()), "width": pa.array(np.full(len(n), kind.itemsize), pa.int32()), "ids": packed})

    return docs.select("doc_id", "source", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, n long, width int, ids binary")


def tokenizer_words(texts: list[str]) -> np.ndarray:
    """How many words of letters, single digits and runs of other signs each text has, by the pattern of the tokenizers that mark word ends; -1 where
    that isn't plain to see: outside the Latin blocks, with blanks or controls, or with an apostrophe."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    kinds = _KINDS[np.minimum(signs, len(_KINDS) - 1)]
    first = np.zeros(len(signs), bool)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    begins = first | (kinds == 1)
    begins[1:] |= kinds[1:] != kinds[:-1]
    both = np.concatenate(([0], np.cumsum(begins))), np.concatenate(([0], np.cumsum(kinds < 0)))
    n, odd = (x[starts + sizes] - x[starts] for x in both)
    return np.where((odd > 0) | (sizes == 0), -1, n)


def _kind(c: str) -> int:
    if c < "!" or "\x7f" <= c <= "\xa0" or c in "'\xad\u0130" or c >= "\u0300":
        return -1
    return 0 if c.isalpha() else 1 if c.isnumeric() else 2


#: Letter, digit, other sign, or (-1) none of these for sure, by code point; the last stands for all beyond.
_KINDS = np.array([_kind(chr(i)) for i in range(0x301)], np.int8)


def encoded(model, texts: list[str], kind: np.dtype, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (words between blanks) in a row, and how many each has. ends: whether an id ends a word of the tokenizer. Texts whose number of such words
    is plain are encoded 500 at a time between blanks, and cut by these ids."""
    words = tokenizer_words(texts) if ends.any() else np.full(len(texts), -1)
    whole, lost = np.flatnonzero(words > 0), []
    ids, sizes, order = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(whole), 500):
        rows = whole[a : a + 500]
        some = np.array(model.encode_batch_fast([" ".join([texts[i] for i in rows.tolist()])], add_special_tokens=False)[0].ids, kind)
        cuts, want = np.flatnonzero(ends[some]), np.cumsum(words[rows])
        if len(cuts) == want[-1]:
            ids.append(some)
            sizes.append(np.diff(cuts[want - 1], prepend=-1))
            order.append(rows)
        else:  # another pattern than thought
            lost.append(rows)
    rest = np.concatenate((np.flatnonzero(words <= 0), *lost))
    more, counts = _marked(model, [texts[i] for i in rest.tolist()], kind)
    ids, sizes, order = np.concatenate((*ids, more)), np.concatenate((*sizes, counts)), np.concatenate((*order, rest))
    starts, back = np.cumsum(sizes) - sizes, np.argsort(order)
    starts, sizes = starts[back], sizes[back]
    before = np.cumsum(sizes) - sizes
    return ids[np.repeat(starts - before, sizes) + np.arange(len(ids))], sizes


def _marked(model, texts: list[str], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The same for any texts: joined by a special token, 500 at a time, that is quicker than one by one."""
    special = [(x.content, i) for i, x in model.get_added_tokens_decoder().items()]
    plain = bool(special) and not any(s in x for s, _ in special for x in texts)
    if not plain:
        lists = [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in lists for i in x], kind), np.array([len(x) for x in lists], np.int64)
    mark, number = special[0]
    ids, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for a in range(0, len(texts), 500):
        some = np.array(model.encode_batch_fast([mark.join(texts[a : a + 500])], add_special_tokens=False)[0].ids, kind)
        marks = np.flatnonzero(some == number)
        sizes.append(np.diff(np.concatenate(([-1], marks, [len(some)]))) - 1)
        ids.append(some[some != number])
    return np.concatenate(ids), np.concatenate(sizes)


def word_ends(model) -> np.ndarray:
    """Whether each id ends a word; all false where the tokenizer doesn't mark ends."""
    out = np.zeros(model.get_vocab_size() + 1, bool)
    suffix = getattr(model.model, "end_of_word_suffix", None)
    if suffix:
        out[[i for x, i in model.get_vocab(False).items() if x.endswith(suffix)]] = True
    return out


class Words:
    """Ids of words by their 64-bit hashes, in flat arrays; the first REMEMBERED words of a worker stay for its next tasks."""

    def __init__(self, kind: np.dtype, model):
        self.ends = word_ends(model)
        self.hashes, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def ids(self, model, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has."""
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        have = at < len(self.hashes)
        have[have] = self.hashes[at[have]] == distinct[have]
        new = np.flatnonzero(~have)
        raw = data.tobytes()
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
        fresh, sizes = encoded(model, texts, self.flat.dtype, self.ends)
        flat = np.concatenate((self.flat, fresh))
        begin, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[have], count[have] = self.starts[at[have]], self.sizes[at[have]]
        begin[new], count[new] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        if len(self.hashes) < REMEMBERED and len(new):
            self.starts, self.sizes = np.insert(self.starts, at[new], begin[new]), np.insert(self.sizes, at[new], sizes)
            self.hashes, self.flat = np.insert(self.hashes, at[new], distinct[new]), flat
        per_word = count[where]
        before = np.cumsum(per_word) - per_word
        return flat[np.repeat(begin[where] - before, per_word) + np.arange(int(per_word.sum()))], per_word


class Rounds:
    """The windows of all queues: ids that each has served after k windows, and where its slice of a window lies on the line. weights: whole numbers, at least 1."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.weights, self.size = totals, weights, window
        # queues in the order in which they are spent: for each stretch of the clock its beginning in ids served, the ids of spent queues and the weight of the others
        self.ends = [Fraction(t, w) for t, w in zip(totals, weights, strict=True)]
        spent, weight, self.stretches = 0, sum(weights), [(Fraction(0), 0, sum(weights))]
        for i in sorted(range(len(totals)), key=lambda i: self.ends[i]):
            served = spent + weight * self.ends[i]
            spent, weight = spent + totals[i], weight - weights[i]
            self.stretches.append((served, spent, weight))
        self.begins, self.spent_at = [x[0] for x in self.stretches], sorted(self.ends)
        self.known: dict[int, tuple[list[int], list[int], list[int]]] = {}

    def served(self, k: int) -> list[int]:
        """Ids that each queue has served after k windows."""
        _, spent, weight = self.stretches[bisect_right(self.begins, k * self.size) - 1]
        if not weight:
            return self.totals
        return [min(t, w * (k * self.size - spent) // weight) for t, w in zip(self.totals, self.weights, strict=True)]

    def window(self, queue: int, place: int) -> int:
        """The window that serves the id at this place of the queue."""
        clock = Fraction(place + 1, self.weights[queue])
        at = bisect_left(self.spent_at, clock)
        _, spent, weight = self.stretches[at]
        return math.ceil((spent + weight * clock) / self.size) - 1

    def slices(self, k: int) -> tuple[list[int], list[int], list[int]]:
        """For each queue: the places of its slice of window k, first and last + 1, and where the slice begins on the line."""
        if k not in self.known:
            if len(self.known) > 2_000_000 // (len(self.totals) + 1):
                self.known.clear()
            before, after = self.served(k), self.served(k + 1)
            at, begins = sum(before), []
            for x, y in zip(before, after, strict=True):
                begins.append(at)
                at += y - x
            self.known[k] = before, after, begins
        return self.known[k]


def proportional(totals: list[int], window: int, weights: list[float] | None = None) -> Rounds:
    """The windows of queues of so many ids, by weights or by the totals themselves. Queues of weight 0 get next to nothing until the others are spent."""
    if weights is None:
        return Rounds(totals, [max(1, x) for x in totals], window)
    if not all(math.isfinite(w) and w >= 0 for w in weights):
        raise ValueError("weights must be finite and not negative")
    if not any(weights):
        return proportional(totals, window)
    return Rounds(totals, [max(1, round(w / sum(weights) * (1 << 40))) for w in weights], window)


def sequence_of(place: int, total: int, length: int) -> tuple[int, int, int]:
    """Sequence, offset in it and ids left in it, for a place on the line."""
    full = total // length
    if place < full * length:
        return place // length, place % length, length - place % length
    nth, at, rest = full, full * length, total - full * length
    while True:
        size = 1 << (rest.bit_length() - 1)
        if place < at + size:
            return nth, place - at, at + size - place
        nth, at, rest = nth + 1, at + size, rest - size


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 1, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of docs (doc_id, source, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, window.

    weights: target proportions by source, not negative; sources not named have 0, and without any weight of a present source the sources' own shares hold."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    tokens = tokenized(docs, tokenizer, end_id).withColumns({"key": F.monotonically_increasing_id(), "mark": F.expr("xxhash64(doc_id, 'queue', crc32(ids))")})
    tokens = written(tokens, compression="zstd")
    totals = tokens.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    queues = sorted(totals.collect(), key=lambda r: (r.source is None, r.source or ""))  # a row a source
    sizes = [r.n for r in queues]
    total = sum(sizes)
    named = [(weights or {}).get(r.source, 0.0) for r in queues]
    chosen = named if any(named) else None
    rounds = proportional(sizes, WINDOW * length, chosen)

    # places first, of slim rows: a queue's parts, by the first digits of the hash, are put in order by their sums, then each part on its own
    spark = docs.sparkSession
    names = spark.createDataFrame([(r.source, i, r.docs) for i, r in enumerate(queues)], "name string, queue int, of_queue long")
    slim = tokens.select("key", "source", "n", "mark").join(names, F.expr("source <=> name"))
    slim = slim.select("key", "n", "mark", "queue", F.expr(f"pmod(shiftrightunsigned(mark, 20), greatest(1L, cast(ceil(of_queue / {PART}D) as bigint)))").alias("part"))
    sums = slim.groupBy("queue", "part").agg(F.sum("n").alias("of_part"))
    bases = sums.withColumn("base", F.expr("sum(of_part) over (partition by queue order by part) - of_part")).drop("of_part")
    placed = slim.join(bases, ["queue", "part"]).select("key", "queue", F.expr("base + sum(n) over (partition by queue, part order by mark, key rows unbounded preceding) - n").alias("place"))
    # then the ids come to their places: a join by a key of even spread
    rows = tokens.select("key", "doc_id", "source", "n", "width", "ids").join(placed.hint("shuffle_hash"), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                out, from_row = [], []
                for i, (queue, place, n, width, ids) in enumerate(zip(*(part.column(c).to_pylist() for c in ("queue", "place", "n", "width", "ids")), strict=True)):
                    ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                    done, k = 0, rounds.window(queue, place)
                    while done < n:
                        first, stop, begin = rounds.slices(k)
                        if place + done >= stop[queue]:
                            k += 1
                            continue
                        sequence, offset, room = sequence_of(begin[queue] + place + done - first[queue], total, length)
                        size = min(n - done, room, stop[queue] - place - done)
                        out.append((done, size, zlib.crc32(ids[4 * done : 4 * (done + size)]), n, sequence, offset, k))
                        from_row.append(i)
                        done += size
                if out:
                    columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window"]
                    rows_ = pa.array(from_row, pa.int64())
                    yield pa.record_batch([part.column("doc_id").take(rows_), *columns[:6], part.column("source").take(rows_), columns[6]], names=["doc_id", *names[:6], "source", "window"])

    form = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, window long"
    return rows.select("doc_id", "source", "queue", "place", "n", "width", "ids").mapInArrow(cut, form)
