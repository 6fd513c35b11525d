"""Substring de-duplication by seed and extend.

A window is `window` consecutive words of one document. Its anchor is the leftmost of its SEED-word sequences with the smallest hash (winnowing), so that
equal windows have their anchors at the same place.

1. Anchors that occur in one document only are left out.
2. Seed: the occurrences of an anchor are joined with its lead, the first occurrence in the document with the smallest id. Extend: both ways from the
   anchor, the match goes as far as the windows around the two places are equal. What matches the lead needs no further comparison, as the lead's document has it.
3. The windows that the lead doesn't have may still be shared by other documents: each is matched with its own first occurrence.
4. Matches of a document with one other document that overlap and have the same distance are one maximal repeat (`repeats`); no repeat is shorter than the window. The words
   of a document's repeats are removed from it; the document with the smallest id keeps them.

Hot anchors, at most HOT of them, are dealt to SALTS parts with a lead each; leads and windows that no earlier document of their part has are compared over the parts.
An occurrence is compared with one other, never with all; places of one document with the same windows around one anchor are one occurrence. Windows count as equal if a 64-bit hash of their anchor and one of all their words both are: over 10^13 windows the chance that any two
others pass for equal is about 10^-13.

Words are runs of other signs than blanks, unchanged; null texts have none. Windows are judged on the input. Rows that repeat an
id are one document to the comparison and keep a row each. Rows with a null id are returned unchanged, and their windows are nobody's repeats. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import blocks, hashed_words, mixed, sequences, written

SEED = 5
#: Most hot anchors (each more than a HOT-th of all occurrences, and COMMON of them), and the parts that each is dealt to.
HOT, COMMON, SALTS = 10_000, 2_000, 64


def anchored(hashes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows that lie in one text, the places of their anchors, and the anchors' hashes; counts: words up to the end of each text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = sequences(hashes, SEED)
    low, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - SEED + 1):
        less = grams[j : j + n] < low
        low[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    end = np.repeat(counts, np.diff(counts, prepend=0))
    starts = np.flatnonzero(np.arange(n) + window <= end[:n])
    return starts, at[starts], low[starts]


def _lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as list i."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Each row's hashes in order; none if null."""
    return [np.sort(np.asarray(x.values)) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _within(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _occurrences(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, doc_id, row, pos, again, before, windows): places of anchors that several documents have, with the hashes of the windows that chose them; `before`
    words before the anchor begins the first of these. again: how far (4 bytes each) the document's other places of the kind lie behind pos; null if there are none. row: a
    hash of the text, for ids that repeat. And the hot anchors (anchor)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                hashes, _, _, counts = hashed_words(data, ends, False)
                starts, places, seeds = anchored(hashes, counts, window)
                fresh = np.flatnonzero(np.diff(places, prepend=-1))
                cuts = np.searchsorted(starts[fresh], np.concatenate(([0], counts)))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "seeds": _lists(seeds[fresh].view(np.int64), cuts, pa.int64())})

    seeds = docs.mapInArrow(seed, f"doc_id {id_type}, seeds array<long>").select("doc_id", F.explode(F.array_distinct("seeds")).alias("anchor"))
    # a document has an anchor once; ids that repeat may let an anchor of theirs through, which the comparison then settles
    shared = written(seeds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    most = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(f"n > {max(COMMON, most // HOT)}").select("anchor")
    found = seeds.join(shared.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column("anchors"))
            for a, b, data, ends in blocks(batch.column("text")):
                hashes, _, _, counts = hashed_words(data, ends, False)
                starts, places, seeds = anchored(hashes, counts, window)
                cuts = np.searchsorted(starts, np.concatenate(([0], counts)))
                keep = np.concatenate([_within(seeds[x:y].view(np.int64), sets[a + i]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])
                if not keep.any():
                    continue
                starts, places, seeds = starts[keep], places[keep], seeds[keep]
                whole = sequences(hashes, window)[starts]
                fresh = np.flatnonzero(np.diff(places, prepend=-1))
                sizes = np.diff(np.append(fresh, len(places)))
                text = np.searchsorted(counts, places[fresh], "right")
                # the first and the last window fix all words around an anchor
                kind = mixed(whole[fresh] + mixed(whole[fresh + sizes - 1] + mixed(seeds[fresh] + mixed((text << 16 | sizes << 8 | places[fresh] - starts[fresh]).astype(np.uint64)))))
                _, one, which = np.unique(kind, return_index=True, return_inverse=True)
                again, more = [None] * len(one), np.flatnonzero(np.bincount(which) > 1)
                if len(more):
                    order = np.argsort(which, kind="stable")
                    cuts = np.searchsorted(which[order], more), np.searchsorted(which[order], more, "right")
                    for k, x, y in zip(more.tolist(), *(c.tolist() for c in cuts), strict=True):
                        at = places[fresh[order[x:y]]]
                        again[k] = (at[1:] - at[0]).astype(np.int32).tobytes()
                text, fresh, sizes = text[one], fresh[one], sizes[one]
                begins = np.concatenate(([0], counts[:-1]))[text]
                own = batch.slice(a, b - a).select(["doc_id", "row"]).take(pa.array(text))
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                windows = whole[np.repeat(fresh - cuts[:-1], sizes) + np.arange(cuts[-1])]
                yield pa.record_batch({"anchor": pa.array(seeds[fresh].view(np.int64)), "doc_id": own.column("doc_id"), "row": own.column("row"), "pos": pa.array((places[fresh] - begins).astype(np.int32)), "again": pa.array(again, pa.binary()), "before": pa.array((places[fresh] - starts[fresh]).astype(np.int32)), "windows": _lists(windows.view(np.int64), cuts, pa.int64())})

    form = f"anchor long, doc_id {id_type}, row long, pos int, again binary, before int, windows array<long>"
    return docs.join(found, "doc_id").mapInArrow(place, form), hot


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
    """Sorted batches, each after the first row of the key that is going on (so that it begins with its group's first row), with the index of each row's first
    row; 1 if the batch's own first row was there before, else 0."""
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if head is None else pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(whole.num_rows, bool)
        change[0] = True
        for c in key:
            x = whole.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        firsts = np.flatnonzero(change)
        lead = firsts[np.cumsum(change) - 1]
        yield whole, lead, int(head is not None)
        head = whole.slice(int(lead[-1]), 1)


_MATCH = "anchor long, salt int, window long, doc_id {0}, row long, start int, stop int, again binary, other {0}, other_start int"


def _extended(occurrences: DataFrame, window: int) -> DataFrame:
    """Matches with the lead of an anchor's part (window null), and windows that the lead doesn't have (other null)."""
    id_type = occurrences.schema["doc_id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, lead, old in _groups(batches, ["anchor", "salt"]):
            ids = whole.column("doc_id")
            other = ids.take(pa.array(lead))
            same_doc = np.asarray(pa.compute.equal(ids, other).to_numpy(zero_copy_only=False), bool)
            pos, before, salt = (whole.column(c).to_numpy() for c in ("pos", "before", "salt"))
            lists = whole.column("windows")
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            begins = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(sizes)), sizes)
            nth = np.arange(len(flat)) - begins[row]
            there = nth - before[row] + before[lead[row]]  # the window at the same distance from the lead's anchor
            good = (there >= 0) & (there < sizes[lead[row]])
            good[good] = flat[good] == flat[begins[lead[row[good]]] + there[good]]
            is_lead = lead == np.arange(len(lead))
            fresh = np.arange(len(lead)) >= old
            hits = np.flatnonzero(good & (~is_lead & ~same_doc & fresh)[row])
            if len(hits):
                r = row[hits]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                last = np.append(first[1:], len(r)) - 1
                r = r[first]
                start = pos[r] - before[r] + nth[hits[first]]
                stop = pos[r] - before[r] + nth[hits[last]] + window
                yield rows(whole, r, None, start, stop, other.take(pa.array(r)), start - pos[r] + pos[lead[r]])
            # of a hot anchor, what no earlier document of this part has is to be compared with the other parts
            left = np.flatnonzero(((~good & ~is_lead[row]) | (same_doc & (salt >= 0))[row]) & fresh[row])
            if len(left):
                r = row[left]
                start = pos[r] - before[r] + nth[left]
                yield rows(whole, r, flat[left], start, start + window, None, None)

    def rows(whole: pa.RecordBatch, r: np.ndarray, windows: np.ndarray | None, start: np.ndarray, stop: np.ndarray, other: pa.Array | None, other_start: np.ndarray | None) -> pa.RecordBatch:
        own = whole.select(["anchor", "salt", "doc_id", "row", "again"]).take(pa.array(r))
        none = pa.nulls(len(r), pa.int32())
        return pa.record_batch({"anchor": own.column("anchor"), "salt": own.column("salt"), "window": pa.nulls(len(r), pa.int64()) if windows is None else pa.array(windows), "doc_id": own.column("doc_id"), "row": own.column("row"), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "again": own.column("again"), "other": pa.nulls(len(r), own.column("doc_id").type) if other is None else other, "other_start": none if other_start is None else pa.array(other_start.astype(np.int32))})

    dealt = occurrences.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "row", "pos")
    return dealt.mapInArrow(extend, _MATCH.format(id_type))


def _first_ones(left: DataFrame) -> DataFrame:
    """Windows (anchor, salt, window, ...) of which an earlier document has an equal one, as matches with that; those of hot anchors that no earlier document of their part has stay (other null)."""
    id_type = left.schema["doc_id"].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, lead, old in _groups(batches, ["anchor", "salt", "window"]):
            ids = whole.column("doc_id")
            other = ids.take(pa.array(lead))
            later = ~np.asarray(pa.compute.equal(ids, other).to_numpy(zero_copy_only=False), bool)
            out = np.flatnonzero((later | (whole.column("salt").to_numpy() >= 0)) & (np.arange(len(lead)) >= old))
            if len(out):
                own = whole.take(pa.array(out))
                found = pa.array(~later[out])
                names = {c: own.column(c) for c in ("anchor", "salt", "window", "doc_id", "row", "start", "stop", "again")}
                names["other"] = pa.compute.if_else(found, pa.scalar(None, ids.type), other.take(pa.array(out)))
                names["other_start"] = pa.compute.if_else(found, pa.scalar(None, pa.int32()), whole.column("start").take(pa.array(lead[out])))
                yield pa.record_batch(names)

    dealt = left.repartition("anchor", "salt", "window").sortWithinPartitions("anchor", "salt", "window", "doc_id", "row", "start")
    return dealt.mapInArrow(match, _MATCH.format(id_type))


def _matches(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row, start, stop, again, other, other_start): words that a document with a smaller id, other, has from other_start on; they stand again so far behind."""
    columns = ["doc_id", "row", "start", "stop", "again", "other", "other_start"]
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    found, hot = _occurrences(docs, window)
    marked = found.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "anchor", "left")  # at most HOT rows
    marked = marked.withColumn("salt", F.expr(f"if(_hot is null, -1, cast(pmod(xxhash64(doc_id), {SALTS}) as int))")).drop("_hot")
    extended = written(_extended(marked, window))
    single = _first_ones(extended.where("other is null"))
    if hot.isEmpty():
        return extended.where("other is not null").unionByName(single).select(columns)
    single = written(single)
    over = _first_ones(single.where("other is null").withColumn("salt", F.lit(-1)))  # at most SALTS rows an anchor and window
    return extended.unionByName(single).where("other is not null").unionByName(over).select(columns)


def merged(spans: list[tuple]) -> list[tuple]:
    """Maximal repeats (other, distance, start, stop) of spans (other, distance, start, stop): those that overlap or touch, with one document and at one distance, are one."""
    out: list[list] = []
    for other, distance, start, stop in sorted(spans):
        if out and out[-1][:2] == [other, distance] and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], stop)
        else:
            out.append([other, distance, start, stop])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Maximal repeats of docs (doc_id, text): doc_id, start, words, other, other_start (0-based words), other the smaller id. Of ids that repeat, each row has its own."""
    rows = _matches(docs.select("doc_id", "text"), window).withColumn("distance", F.expr("start - other_start"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans = None, []
        for batch in batches:
            out = []
            for doc, row, other, distance, start, stop, again in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "other", "distance", "start", "stop", "again")), strict=True):
                if (doc, row) != now:
                    out += [(now[0], *x) for x in merged(spans)] if now else []
                    now, spans = (doc, row), []
                spans += [(other, distance + x, start + x, stop + x) for x in (0, *np.frombuffer(again or b"", np.int32).tolist())]
            yield batch_of(out, batch.schema)
            schema = batch.schema
        if now:
            yield batch_of([(now[0], *x) for x in merged(spans)], schema)

    def batch_of(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kind = schema.field("doc_id").type
        columns = ((x[0] for x in out), (x[3] for x in out), (x[4] - x[3] for x in out), (x[1] for x in out), (x[3] - x[2] for x in out))
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, (kind, pa.int32(), pa.int32(), kind, pa.int32()), strict=True)], names=["doc_id", "start", "words", "other", "other_start"])

    dealt = rows.select("doc_id", "row", "other", "distance", "start", "stop", "again").repartition("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return dealt.mapInArrow(merge, f"doc_id {id_type}, start int, words int, other {id_type}, other_start int")


def remove_repeats(docs: DataFrame, window: int = 13, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The columns keep (doc_id, unless given) of docs (doc_id, text) with n_words, n_removed, kept_sha256, and kept_text if with_text."""
    keep = keep or ["doc_id"]
    docs = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    # words alone decide what goes: of a document's repeats only the places go on
    spans = _matches(docs, window).groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "stop", "again")).alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            firsts, stops = (flat.field(c).to_numpy() for c in (0, 1))
            more = flat.field(2)
            repeated = more.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            for a, b, data, ends in blocks(batch.column("text")):
                _, _, _, counts = hashed_words(data, ends, False)
                removed, marks, kept = [], [], []
                raw, begin, at = data.tobytes(), 0, 0
                for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    words = raw[begin:end].split()
                    gone = 0
                    x, y = cuts[a + i], cuts[a + i + 1]
                    if y > x:
                        steps = np.zeros(n - at + 1, np.int64)
                        np.add.at(steps, firsts[x:y], 1)
                        np.add.at(steps, stops[x:y], -1)
                        for k in (x + np.flatnonzero(repeated[x:y])).tolist():
                            behind = np.frombuffer(more[k].as_py(), np.int32)
                            np.add.at(steps, firsts[k] + behind, 1)
                            np.add.at(steps, stops[k] + behind, -1)
                        stay = np.cumsum(steps[:-1]) == 0
                        gone = int((~stay).sum())
                        words = list(compress(words, stay.tolist()))
                    text = b" ".join(words)
                    removed.append(gone)
                    marks.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode("utf-8", "replace") if with_text else None)
                    begin, at = end, n
                out = {c: batch.column(c).slice(a, b - a) for c in keep}
                out |= {"n_words": pa.array(np.diff(counts, prepend=0), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(marks, pa.string())}
                yield pa.record_batch(out | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    form = T.StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    rows = docs.withColumn("_hash", F.xxhash64("text")).join(spans, F.expr("doc_id = _doc and _hash = _row"), "left").drop("_hash", "_doc", "_row")
    return rows.mapInArrow(cut, form.add("kept_text", "string") if with_text else form)


ORACLE = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 11)) i from w where len(w) >= 13),
k as (select doc_id, i, array_to_string(w[i:i + 12], ' ') x from p),
f as (select x, min(doc_id) first from k group by x),
h as (select distinct doc_id, unnest(range(i, i + 13)) i from k join f using (x) where doc_id > first),
g as (select doc_id, list(i) gone from h group by doc_id),
o as (select doc_id, w, coalesce(gone, []) gone from w left join g using (doc_id)),
q as (select doc_id, w, gone, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda t: not list_contains(gone, t[2])), lambda t: t[1]) kept from o)
select doc_id, len(w)::bigint n_words, len(gone)::bigint n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) kept_sha256 from q
"""
