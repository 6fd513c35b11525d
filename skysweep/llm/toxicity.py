"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding: lower case; accented, full-width and look-alike letters become plain Latin ones; l becomes i (so that 1 and ! can stand
for either); digits and signs directly before a letter become the letter they stand for; all else becomes a blank. Words with digits or signs (BEHIND) directly after a letter are folded in a second way
too, with these as letters, so that either reading can hold a term. Runs of substitutions may have any length. Terms
are whole words and word beginnings; of several that begin at one place the heaviest counts. A hit inside an exception
phrase doesn't count. The hits' weights are summed, and normalised by the text's words; two features, the sum and the density,
go through a logistic curve.

Weights, exception phrases and curve are learned from labelled rows: a term's weight is its log odds, and a term enters only if so many toxic documents with it are unlikely by chance. A
phrase of a term's word and a neighbour is an exception if only clean documents have it, and so many that for the term's share of toxic ones this has a chance under EXCEPTED; some
everyday phrases (EXCEPTIONS) always are.
Copies among the labelled rows count once, as the longest of them. The bound max_rows on labelled rows bounds everything else that is learned. It thins the classes by different
parts: where terms are chosen and in the curve's intercept this is undone, so that scores keep the classes' true shares however large the tables are. Null and empty texts have no hits and so the lowest score. Extra columns are not looked at.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import dropped, hashed_words, sequences, written
from skysweep.llm.language import _groups

# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "n", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "i", "ø": "o", "đ": "d"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
#: What may stand for a letter at a word's end as well: not the signs that end sentences.
BEHIND = "013457 8@$€".replace(" ", "")
#: Harmless phrases that hold a word of the lexicon in everyday English.
EXCEPTIONS = ("clown fish", "trash can", "trash bag", "trash bin", "white trash can", "not stupid", "class clown act")
#: Chance under which a phrase's being clean is no chance.
EXCEPTED = 1e-6
#: Letters in the word beginnings that may become terms.
BEGINNINGS = (4, 5, 6)

_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it folds to, and what it stands for before a letter (else 0)."""
    if not _TABLES:
        fold = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                low = LOOKALIKES.get(low[0]) or LOOKALIKES.get(b := unicodedata.normalize("NFKD", low)[0].lower(), b)
                fold[i] = ord("i" if low == "l" else low)
        fold[10] = 10
        stands = np.zeros(0x110000, np.uint32)
        for c, to in STANDS_FOR.items():
            stands[ord(c)] = ord(to)
            if ord(c) < 127:
                stands[ord(c) + 0xFEE0] = ord(to)
        _TABLES.append((fold, stands))
    return _TABLES[0]


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places as runs: for each place its run, and each run's first and last place."""
    first = np.concatenate(([True], np.diff(marks) > 1))
    run = np.cumsum(first) - 1
    return run, marks[first], marks[np.append(np.flatnonzero(first)[1:] - 1, len(marks) - 1)]


def _text(signs: np.ndarray) -> str:
    return signs.astype(np.uint8).tobytes().decode("latin-1") if signs.max(initial=0) < 256 else signs.tobytes().decode("utf-32-le", "replace")


def _both_folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of the folded texts, each between blanks, one a line; and of their second folding, if it differs."""
    joined = "\n".join(f" {x} ".replace("\n", " ") if x else "  " for x in texts)
    fold, stands = _tables()
    signs = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    out = fold[signs]
    marks = np.flatnonzero((stands[signs] > 0) & (out == 32))
    if len(marks):
        run, _, last = _runs(marks)
        good = marks[(np.append(out, 32)[last + 1] > 32)[run]]
        out[good] = stands[signs[good]]
    marks = np.flatnonzero(_behind()[signs] & (out == 32))
    if not len(marks):
        return out, None
    run, first, _ = _runs(marks)
    good = marks[(out[first - 1] > 32)[run]]  # every text begins with a blank
    if not len(good):
        return out, None
    other = out.copy()
    other[good] = stands[signs[good]]
    return out, other


def _behind() -> np.ndarray:
    """Whether each code point may stand for a letter behind one."""
    if len(_TABLES) < 2:
        _tables()
        own = np.zeros(0x110000, bool)
        for c in BEHIND:
            own[[ord(c), ord(c) + 0xFEE0] if ord(c) < 127 else [ord(c)]] = True
        _TABLES.append((own, own))
    return _TABLES[1][0]


def folded(texts: list[str | None]) -> str:
    """The folded texts, each between blanks, one a line."""
    return _text(_both_folded(texts)[0])


def folded_phrase(phrase: str) -> str:
    return folded([phrase]).strip()


@dataclass
class Lexicon:
    """terms: " word " or " beginning" with weights; exceptions: folded phrases; curve: intercept and two slopes."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term) - (term[-1] == " "), weight, len(term)))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 1, None, len(phrase) + 2))
        if len(found):
            found.make_automaton()
        return found


def features(automaton, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the sum of its hits' weights, and its number of words."""
    signs, other = _both_folded(texts)
    joined = _text(signs)
    ends = np.append(np.flatnonzero(signs == 10), len(signs))
    blank = signs <= 32
    words = np.flatnonzero(blank[:-1] & ~blank[1:])
    n_words = np.diff(np.searchsorted(words, ends), prepend=0)
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight, whole) in automaton.iter(joined):
            start = end - whole + 1
            if weight is None:
                spared.append((start, start + length))
            elif best.get(start, (0.0, 0))[0] < weight:
                best[start] = (weight, start + length)
        if other is not None:  # words that the second folding changes are looked up on their own
            gap = np.flatnonzero(other <= 32)
            nth = np.unique(np.searchsorted(gap, np.flatnonzero(other != signs)))
            for a, b in zip(gap[nth - 1].tolist(), np.append(gap, len(other))[nth].tolist(), strict=True):
                for end, (length, weight, whole) in automaton.iter(f" {_text(other[a + 1 : b])} "):
                    start = a + end - whole + 1
                    if weight is not None and best.get(start, (0.0, 0))[0] < weight:
                        best[start] = (weight, start + length)
    for a, b in spared:
        for start in [x for x in range(a, b) if x in best and best[x][1] <= b]:
            del best[start]
    at = np.fromiter(best, np.int64, len(best))
    sums = np.bincount(np.searchsorted(ends, at), np.fromiter((w for w, _ in best.values()), float, len(best)), len(texts))
    return sums, n_words


def _x(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(sums)), np.log1p(sums), np.log1p(100 * sums / np.maximum(words, 1))), 1)


def _unlikely(pos: int, n: int, p: float) -> float:
    """Log of the chance of pos or more toxic among n documents."""
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(pos, n + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(x - top) for x in terms))


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, chance: float = 1e-6) -> Lexicon:
    """Learns from docs (doc_id, text) that have labels (doc_id, toxic), one each: about max_rows of each class, picked by a hash of
    the id. This bound holds the broadcast ids and the driver's share to a fixed size. Rows with a null label or id are left out; a null text is empty."""
    labels = labels.selectExpr("doc_id", "int(toxic > 0) as toxic").where("toxic is not null and doc_id is not null")
    totals = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    buckets = {k: int(min(1.0, max_rows / n) * 1048576) + 1 for k, n in totals.items()}
    cut = " or ".join(f"(toxic = {k} and pmod(xxhash64(doc_id, 'fit'), 1048576) < {b})" for k, b in buckets.items())
    empty = Lexicon({}, [folded_phrase(x) for x in EXCEPTIONS])
    if len(totals) < 2:
        return empty
    thinned = min(buckets[0], 1048576) / min(buckets[1], 1048576)  # a clean row's chance to be in the sample against a toxic one's

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for text in batch.column("text").to_pylist():
                data = np.frombuffer(text.encode(), np.uint8)
                h = hashed_words(data, np.array([len(data)]), True)[0]
                s = sequences(h, min(5, len(h))) if len(h) else np.zeros(1, np.uint64)
                keys.append(int(s.min()) - (1 << 63))
            yield pa.record_batch({"key": pa.array(keys, pa.int64()), "text": batch.column("text").cast(pa.string()), "toxic": batch.column("toxic")})

    rows = docs.selectExpr("doc_id", "coalesce(text, '') as text").join(F.broadcast(labels.where(cut)), "doc_id").select("text", "toxic")
    rows = rows.mapInArrow(keyed, "key long, text string, toxic int").groupBy("key", "toxic").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")).select("text", "toxic")
    rows = written(rows)  # read for terms, phrases and curve

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        docs = [0, 0]
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            for a, texts in _groups(batch):
                for line, label in zip(folded(texts).split("\n"), labels[a : a + len(texts)], strict=True):
                    seen[label].update(_terms(set(line.split())))
                    docs[label] += 1
            if max(map(len, seen)) > 500_000:
                yield out(seen)
                seen = (Counter(), Counter())
        seen[0][""], seen[1][""] = docs
        yield out(seen)

    def out(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(seen[0] | seen[1])
        return pa.record_batch({"term": pa.array(names, pa.string()), "neg": pa.array([seen[0][x] for x in names], pa.int64()), "pos": pa.array([seen[1][x] for x in names], pa.int64())})

    counts = rows.mapInArrow(count, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    got = counts.where(f"term = '' or (pos >= 3 and pos * {thinned!r}D > neg)").collect()  # of max_rows toxic texts at most
    n_neg, n_pos = next(((r.neg, r.pos) for r in got if not r.term), (0, 0))
    if not n_pos or not n_neg:
        return empty
    base, weights = n_pos / (n_pos + n_neg), {}
    shares = {r.term: r.pos / (r.pos + r.neg + 1) for r in got}
    for r in got:
        if r.term and r.pos / (r.pos + r.neg) > base and (c := _unlikely(r.pos, r.pos + r.neg, base)) < math.log(chance):
            weights[r.term] = (c, math.log((r.pos + 0.5) / (n_pos + 1)) - math.log((r.neg + 0.5) / (n_neg + 1)))
    lexicon = Lexicon({t: w for t, (_, w) in sorted(weights.items()) if w > 0}, empty.exceptions)
    if not lexicon.terms:
        return lexicon
    lexicon.exceptions = sorted({*empty.exceptions, *_spared(rows, {t: shares[t] for t in lexicon.terms})})
    seen = scored(rows, lexicon, ["toxic"]).select("toxic", "hits", "words").toPandas()  # as many rows as the bound on labelled rows allows
    seen = seen.sort_values(["toxic", "hits", "words"])
    dropped(rows)
    x, y = _x(seen.hits.to_numpy(), seen.words.to_numpy()), seen.toxic.to_numpy(float)
    b = np.array([-2.0, 1.0, 0.0])
    for _ in range(50):  # logistic regression with a weak pull to zero, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * b)
        b = b + np.clip(step, -2, 2)
    lexicon.curve = (b[0] + math.log(thinned), *b[1:])
    return lexicon


def _spared(rows: DataFrame, shares: dict[str, float]) -> list[str]:
    """Phrases of a term's word and the word before or behind it that only clean texts have, against the terms' shares of toxic texts."""
    whole, parts = {t.strip() for t in shares if t[-1] == " "}, tuple(t.strip() for t in shares if t[-1] != " ")

    def share(phrase: str) -> float:
        """The largest of the terms in it."""
        return max((shares[t] for w in phrase.split() for t in _terms({w}) if t in shares), default=0.0)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, seen = batch.column("toxic").to_pylist(), (Counter(), Counter())
            for a, texts in _groups(batch):
                for line, label in zip(folded(texts).split("\n"), labels[a : a + len(texts)], strict=True):
                    words = line.split()
                    at = [i for i, w in enumerate(words) if w in whole or w.startswith(parts)]
                    seen[label].update({" ".join(words[j : j + 2]) for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1})
            names = sorted(seen[0] | seen[1])
            yield pa.record_batch({"term": pa.array(names, pa.string()), "neg": pa.array([seen[0][x] for x in names], pa.int64()), "pos": pa.array([seen[1][x] for x in names], pa.int64())})

    sums = rows.mapInArrow(phrases, "term string, neg long, pos long").groupBy("term").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    return [r.term for r in sums.where("pos = 0 and neg > 1").collect() if (1 - share(r.term)) ** r.neg < EXCEPTED]


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns keep of docs (which has a column text) with score, hits (summed weight) and words."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of max_rows toxic texts

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            for a, texts in _groups(batch):
                sums, words = features(automaton, texts)
                p = 1 / (1 + np.exp(-np.clip(_x(sums, words) @ np.array(lexicon.curve), -30, 30)))
                own = {c: batch.column(c).slice(a, len(texts)) for c in keep}
                yield pa.record_batch(own | {"score": pa.array(p, pa.float64()), "hits": pa.array(sums, pa.float64()), "words": pa.array(words, pa.int64())})

    found = T.StructType([docs.schema[c] for c in keep]).add("score", "double").add("hits", "double").add("words", "long")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, found)
