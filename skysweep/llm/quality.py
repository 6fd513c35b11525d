"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The features of a text: its lower-cased words, each in one of 2**BITS buckets by its hash, as a vector of unit length; statistics of its structure (STATISTICS), each shared
between the two nearest of a few fixed bins; and metadata columns: numbers in bins by their logarithm, strings by their hash, null in a bin of its own. The score is a
logistic curve of w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, and the pairs cost no more than the features: for each factor their sum is half of
(sum v_i x_i)**2 - sum (v_i x_i)**2.

The fit reads labelled rows: of each class about max_rows, picked by a hash of the id (this bound holds the broadcast ids and the time; it thins the classes by different parts, which the
intercept undoes). A round's gradient is worked out where the rows are and summed by feature; the driver sees one row a feature, never a text. Scoring reads whole
texts, all rows alike. A null text is empty; an empty text has its statistics only. Without labels of both classes every score is one half. Of several labels of an id the
largest counts; rows with a null id or label are left out. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import blocks, dropped, hashed_words, written

#: Buckets of words (and of strings of metadata), factors, bins of a statistic, rounds of the fit.
BITS, FACTORS, BINS, ROUNDS = 14, 8, 16, 40
STEP, PULL = 0.08, 1e-4
#: Statistics with the ends of their bins: logarithms of words and of lines; bytes a word, words a line (logarithm); shares of letters that are capitals, of bytes
#: that are digits, that are signs, of words that end in two signs or more; distinct words to words; share of the most common word; shares of lines and of three-word sequences that repeat earlier ones.
STATISTICS = {"words": (0, 12), "lines": (0, 8), "word_bytes": (0, 16), "line_words": (0, 8), "capitals": (0, 1), "digits": (0, 0.5), "signs": (0, 0.5), "signed": (0, 1), "distinct": (0, 1), "commonest": (0, 0.5), "repeated_lines": (0, 1), "repeated_sequences": (0, 1)}

_CODES = np.arange(256)
_BLANK = np.isin(_CODES, [32, *range(9, 14)])
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SIGN = (_CODES > 32) & (_CODES < 127) & ~_CAPITAL & ~_DIGIT & ~((_CODES >= 97) & (_CODES <= 122))
_LETTER = ~_BLANK & ~_SIGN & ~_DIGIT & (_CODES > 32)


def _sums(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the marks lie in each text."""
    return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[np.concatenate(([0], ends))])


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n owners: distinct keys, and how often the commonest occurs."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))) if len(k) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[new], times)
    return np.bincount(o[new], minlength=n), most


def statistics(data: np.ndarray, ends: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Rows of STATISTICS, one a text. The words of text i are those before upto[i]."""
    n, n_words = len(ends), np.diff(upto, prepend=0)
    size, owner = np.diff(ends, prepend=0), np.repeat(np.arange(n), n_words)
    lines = _sums(data == 10, ends) + 1
    whole, per_word = np.maximum(size, 1), np.maximum(n_words, 1)
    signed = _SIGN[data[stops - 1]] & _SIGN[data[np.maximum(stops - 2, 0)]] & (stops - starts > 2) if len(stops) else np.zeros(0, bool)
    distinct, commonest = _repeats(hashes, owner, n)
    # lines by the sum of their words' hashes, each word weighted by its place in the line
    breaks = np.searchsorted(starts, np.flatnonzero(data == 10))
    first = np.unique(np.concatenate((breaks, np.concatenate(([0], upto[:-1])))))
    first = first[first < len(hashes)]
    place = (np.arange(len(hashes)) - np.repeat(first, np.diff(np.append(first, len(hashes))))).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
    sums = np.add.reduceat(hashes * (2 * place + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
    of = owner[first] if len(first) else np.zeros(0, np.int64)
    n_lines, own_lines = np.bincount(of, minlength=n), _repeats(sums, of, n)[0]
    triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else np.zeros(0, np.uint64)
    inside = owner[:-2] == owner[2:] if len(hashes) > 2 else np.zeros(0, bool)
    n_triples, own_triples = np.bincount(owner[: len(inside)][inside], minlength=n), _repeats(triples[inside], owner[: len(inside)][inside], n)[0]
    columns = [
        np.log1p(n_words), np.log1p(lines), (size - _sums(_BLANK[data], ends)) / per_word, np.log1p(n_words / lines),
        _sums(_CAPITAL[data], ends) / np.maximum(_sums(_LETTER[data], ends), 1), _sums(_DIGIT[data], ends) / whole, _sums(_SIGN[data], ends) / whole,
        np.bincount(owner, signed, n) / per_word, distinct / per_word, commonest / per_word, 1 - own_lines / np.maximum(n_lines, 1), 1 - own_triples / np.maximum(n_triples, 1),
    ]
    columns[-2:] = [np.where(count > 0, c, 0) for c, count in zip(columns[-2:], (n_lines, n_triples), strict=True)]
    return np.stack(columns, 1)


def binned(values: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Two bins for each value, the nearest, and its shares in them."""
    at = np.clip((values - low) / (high - low), 0, 1) * (BINS - 1)
    left = np.minimum(at.astype(np.int64), BINS - 2)
    return np.stack((left, left + 1), 1), np.stack((left + 1 - at, at - left), 1)


@dataclass
class Features:
    """Turns texts and metadata into (row, feature, value) triples. metadata: names of columns, with whether they are numbers."""

    metadata: dict[str, bool]

    @property
    def size(self) -> int:
        return 2**BITS + BINS * len(STATISTICS) + sum(BINS + 1 if number else 2**BITS + 1 for number in self.metadata.values())

    def of(self, data: np.ndarray, ends: np.ndarray, columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(ends)
        hashes, starts, stops, upto = hashed_words(data, ends, True)
        owner = np.repeat(np.arange(n), np.diff(upto, prepend=0))
        keys, times = np.unique(owner * 2**BITS + (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        rows = keys >> BITS
        length = np.sqrt(np.bincount(rows, times.astype(float) ** 2, n))
        out = [(rows, keys & 2**BITS - 1, times / length[rows])]
        at = 2**BITS
        every = np.repeat(np.arange(n), 2)
        for column, (low, high) in zip(statistics(data, ends, hashes, starts, stops, upto).T, STATISTICS.values(), strict=True):
            bins, shares = binned(column, low, high)
            out.append((every, at + bins.ravel(), shares.ravel()))
            at += BINS
        for column, number in zip(columns, self.metadata.values(), strict=True):
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            gone = np.setdiff1d(np.arange(n), there)
            known = column.drop_null()
            if number:
                x = known.cast(pa.float64()).to_numpy()
                bins, shares = binned(np.sign(np.nan_to_num(x)) * np.log1p(np.abs(np.nan_to_num(x))), 0, 20)
                out.append((np.repeat(there, 2), at + bins.ravel(), shares.ravel()))
                last = BINS
            else:
                names = known.cast(pa.large_binary())
                text = np.frombuffer(b"".join(b"-" + x.as_py().translate(None, b" \t\n\x0b\x0c\r") for x in names), np.uint8)
                stop = np.cumsum([1 + len(x.as_py().translate(None, b" \t\n\x0b\x0c\r")) for x in names]).astype(np.int64)
                out.append((there, at + (hashed_words(text, stop, False)[0] >> np.uint64(64 - BITS)).astype(np.int64), np.ones(len(there))))
                last = 2**BITS
            out.append((gone, np.full(len(gone), at + last), np.ones(len(gone))))
            at += last + 1
        rows, ids, x = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.argsort(rows, kind="stable")
        keep = order[x[order] != 0]
        return rows[keep], ids[keep], x[keep]


@dataclass
class Machine:
    """w0, one weight a feature, and FACTORS factors a feature."""

    features: Features
    base: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n sums before the curve, the summed factors of each row, and those of each feature in it."""
        own = self.factors[ids] * x[:, None]
        cuts = np.searchsorted(rows, np.arange(n + 1))
        add = lambda a: np.diff(np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)))[cuts], axis=0)
        sums = add(own)
        return self.base + add(self.weights[ids] * x) + 0.5 * ((sums**2).sum(1) - add((own**2).sum(1))), sums, own


def curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(docs: DataFrame, features: Features, extra: str) -> DataFrame:
    """docs (text, metadata, extra) as extra with lists of features and values."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                rows, ids, x = features.of(data, ends, [batch.column(c).slice(a, b - a) for c in features.metadata])
                cuts = pa.array(np.searchsorted(rows, np.arange(b - a + 1)), pa.int32())
                yield pa.record_batch({extra: batch.column(extra).slice(a, b - a), "ids": pa.ListArray.from_arrays(cuts, pa.array(ids, pa.int32())), "xs": pa.ListArray.from_arrays(cuts, pa.array(x, pa.float64()))})

    schema = T.StructType([docs.schema[extra]]).add("ids", T.ArrayType(T.IntegerType())).add("xs", T.ArrayType(T.DoubleType()))
    return docs.select(extra, "text", *features.metadata).mapInArrow(turn, schema)


def features_of(docs: DataFrame, metadata: tuple[str, ...]) -> Features:
    return Features({c: isinstance(docs.schema[c].dataType, T.NumericType) for c in metadata})


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), max_rows: int = 6000) -> Machine:
    """Learns from docs (doc_id, text, metadata) that have labels (doc_id, quality)."""
    features = features_of(docs, metadata)
    random = np.random.default_rng(11)
    machine = Machine(features, 0.0, np.zeros(features.size), np.zeros((features.size, FACTORS)))
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality > 0)")).alias("y"))
    totals = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return machine
    chances = {y: int(min(1.0, max_rows / n) * 1048576) + 1 for y, n in totals.items()}
    picked = labels.where(" or ".join(f"(y = {y} and pmod(xxhash64(doc_id, 'quality'), 1048576) < {c})" for y, c in chances.items()))
    rows = written(_featured(docs.where("doc_id is not null").join(F.broadcast(picked), "doc_id"), features, "y"))  # the bound max_rows holds
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        dropped(rows)
        return machine
    weight = {y: sum(counts.values()) / (2 * n) for y, n in counts.items()}  # the classes count alike in the fit
    machine.factors = random.normal(0, 0.05, machine.factors.shape)
    state = np.concatenate((machine.weights[:, None], machine.factors), 1)
    mean, square, base = np.zeros_like(state), np.zeros_like(state), np.zeros(3)
    for step in range(1, ROUNDS + 1):
        gradient, intercept = _gradient(rows, machine, weight)
        total = sum(counts.values())
        gradient = gradient / total + PULL * state
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        base[1:] = 0.9 * base[1] + 0.1 * intercept / total, 0.99 * base[2] + 0.01 * (intercept / total) ** 2
        rate = STEP * min(1.0, 2 * (1 - step / (ROUNDS + 1)))
        fade = 1 - 0.9**step, 1 - 0.99**step
        state = state - rate * (mean / fade[0]) / (np.sqrt(square / fade[1]) + 1e-8)
        base[0] -= rate * (base[1] / fade[0]) / (math.sqrt(base[2] / fade[1]) + 1e-8)
        machine = Machine(features, float(base[0]), state[:, 0].copy(), state[:, 1:].copy())
    machine.base += math.log(totals[1] / totals[0])  # the classes' true shares
    dropped(rows)
    return machine


def _gradient(rows: DataFrame, machine: Machine, weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """The gradient of the summed loss: by feature (weight, factors), and of the intercept."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def slope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        total = np.zeros((len(machine.weights) + 1, 1 + FACTORS))
        for batch in batches:
            n, lists = batch.num_rows, batch.column("ids")
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            ids, x = lists.flatten().to_numpy(), batch.column("xs").flatten().to_numpy()
            z, sums, own = machine.parts(row, ids, x, n)
            y = batch.column("y").to_numpy()
            off = (curve(z) - y) * np.where(y > 0, weight[1], weight[0])
            total[-1, 0] += off.sum()
            lead = off[row] * x
            total[:-1, 0] += np.bincount(ids, lead, len(machine.weights))
            for f in range(FACTORS):
                total[:-1, 1 + f] += np.bincount(ids, lead * (sums[row, f] - own[:, f]), len(machine.weights))
        at = np.flatnonzero(total.any(1))
        yield pa.record_batch({"id": pa.array(at, pa.int32())} | {f"g{i}": pa.array(total[at, i]) for i in range(1 + FACTORS)})

    names = [f"g{i}" for i in range(1 + FACTORS)]
    sums = rows.mapInArrow(slope, "id int, " + ", ".join(f"{c} double" for c in names)).groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # one row a feature
    out = np.zeros((len(machine.weights) + 1, 1 + FACTORS))
    out[sums.column("id").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in names], 1)
    shared.destroy()
    return out[:-1], float(out[-1, 0])


def scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns keep of docs (which has text and the metadata) with score."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 9 numbers a feature

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                triples = machine.features.of(data, ends, [batch.column(c).slice(a, b - a) for c in machine.features.metadata])
                own = {c: batch.column(c).slice(a, b - a) for c in keep}
                yield pa.record_batch(own | {"score": pa.array(curve(machine.parts(*triples, b - a)[0]), pa.float64())})

    schema = T.StructType([docs.schema[c] for c in keep]).add("score", "double")
    return docs.select(*dict.fromkeys([*keep, "text", *machine.features.metadata])).mapInArrow(score, schema)
