"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (lower-cased; "▁" opens a word). Each language has one probability per
piece, fitted by expectation-maximisation. The likelihood of a word is the sum over all its segmentations into pieces,
by the forward algorithm; the likelihood of a text is the product over its words (runs of letters, lower-cased).

The fit runs on the executors: a round's expected counts are worked out where the words are, and summed by piece; the driver sees one row a
piece of the vocabulary and never a word.

Letters outside the vocabulary get one fixed probability in every language. Words over BLOCK letters are scored in blocks
of BLOCK letters. Texts are read whole. Null texts and texts without a letter get the language "und" and score 0; ties
between languages go to the first in code-point order. Extra columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import dropped, mixed, written

#: Letters in a scored block, letters in the longest piece used, probability of a letter that is no piece.
BLOCK, LONGEST, UNKNOWN = 64, 8, 1e-4
#: Words whose likelihood a task remembers.
REMEMBERED = 1 << 18
_START = 0x2581
_R = mixed(np.arange(11, 11 + LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def pieces(vocabulary: str | None = None) -> list[str]:
    """Lower-cased pieces of the vocabulary that are letters, with or without the opening mark, of LONGEST signs at most."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({x for x in found if 0 < len(x) <= LONGEST and (x == "▁" or x.removeprefix("▁").isalpha())})


def _piece_hash(piece: str) -> int:
    signs = np.array([ord(x) for x in reversed(piece)], np.uint64)
    return int(mixed(np.array([np.add.reduce(signs * _R[: len(signs)]) ]) + _R[LONGEST:] * np.uint64(len(signs)))[0])


class Pieces:
    """Piece hashes in order, with the piece probabilities of each language in the same order; the last row is "no piece"."""

    def __init__(self, vocabulary: list[str], languages: list[str]):
        self.hashes = np.unique(np.array([_piece_hash(x) for x in vocabulary], np.uint64))
        self.languages = languages
        self.chance = np.full((len(self.hashes) + 1, len(languages)), 1 / max(1, len(self.hashes)))
        self.chance[-1] = 0

    def ids(self, words: np.ndarray) -> list[np.ndarray]:
        """words: code points, one padded word a row. For each length l: the piece that ends at each place, or the last id."""
        out, run = [], np.zeros(words.shape, np.uint64)
        for k in range(min(LONGEST, words.shape[1])):
            run = run.copy()
            run[:, k:] += words[:, : words.shape[1] - k] * _R[k]
            h = mixed(run[:, k:] + _R[LONGEST:] * np.uint64(k + 1))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.full(words.shape, len(self.hashes), np.int32)
            found[:, k:] = np.where(self.hashes[at] == h, at, len(self.hashes))
            out.append(found)
        return out

    def _weights(self, ids: list[np.ndarray], j: int, k: int) -> np.ndarray:
        p = self.chance[ids[k][:, j]]
        return np.where((ids[0][:, j] == len(self.hashes))[:, None], UNKNOWN, p) if k == 0 else p

    def forward(self, ids: list[np.ndarray], width: int) -> np.ndarray:
        """Summed probability of all segmentations of the first j signs: (words, j, languages)."""
        a = np.zeros((len(ids[0]), width + 1, len(self.languages)))
        a[:, 0] = 1
        for j in range(width):
            for k in range(min(LONGEST, j + 1)):
                a[:, j + 1] += a[:, j - k] * self._weights(ids, j, k)
        return a

    def expected(self, signs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words, runs of the signs, that occur counts times in each language: (pieces + 1, languages)."""
        seen, order = np.zeros_like(self.chance), np.argsort(sizes, kind="stable")
        for a in range(0, len(order), 4096):
            rows = order[a : a + 4096]
            words, n = padded(signs, starts[rows], sizes[rows]), sizes[rows] + 1
            ids, width = self.ids(words), words.shape[1]
            fwd = self.forward(ids, width)
            back = np.zeros_like(fwd)
            back[np.arange(len(rows)), n] = 1
            for j in range(width - 1, -1, -1):
                for k in range(min(LONGEST, width - j)):
                    back[:, j] += back[:, j + k + 1] * self._weights(ids, j + k, k)
            scale = counts[rows] / np.maximum(fwd[np.arange(len(rows)), n], 1e-300)
            for j in range(width):
                for k in range(min(LONGEST, j + 1)):
                    use = fwd[:, j - k] * self.chance[ids[k][:, j]] * back[:, j + 1] * scale
                    for x in range(use.shape[1]):
                        seen[:, x] += np.bincount(ids[k][:, j], use[:, x], len(seen))
        return seen

    def maximised(self, seen: np.ndarray) -> None:
        """Probabilities from expected counts, every piece seen a little."""
        seen = seen + 0.01
        seen[-1] = 0
        self.chance = seen / seen.sum(0)

    def likelihoods(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log likelihood of each padded word in each language."""
        out, order = np.zeros((len(words), len(self.languages))), np.argsort(sizes, kind="stable")
        for a in range(0, len(order), 8192):
            rows = order[a : a + 8192]
            width = int(sizes[rows].max())
            fwd = self.forward(self.ids(words[rows, :width]), width)
            out[rows] = np.log(np.maximum(fwd[np.arange(len(rows)), sizes[rows]], 1e-300))
        return out


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, and for each block of letters its text's index, first sign and size."""
    joined = "\n".join(x.lower().replace("\n", " ") if x else "" for x in texts)
    signs = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate(([False], _letters()[signs], [False]))
    starts, ends = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
    parts = (ends - starts + BLOCK - 1) // BLOCK
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * BLOCK, np.minimum(np.repeat(ends, parts), np.repeat(starts, parts) + (nth + 1) * BLOCK)
    text = np.searchsorted(np.flatnonzero(signs == 10), starts)
    return signs, text, starts, ends - starts


def hashed(signs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    by_place = mixed(np.arange(1, BLOCK + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return mixed(np.add.reduceat((signs[np.repeat(starts, sizes) + place].astype(np.uint64) + np.uint64(1)) * by_place[place], at) + sizes.astype(np.uint64))


def padded(signs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One word a row, after the opening mark."""
    width = int(sizes.max(initial=0))
    out = np.zeros((len(starts), width + 1), np.uint64)
    out[:, 0] = _START
    reach = np.arange(width)
    inside = reach[None, :] < sizes[:, None]
    out[:, 1:][inside] = signs[(starts[:, None] + reach[None, :])[inside]]
    return out


def _groups(batch: pa.RecordBatch, at_most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in runs of about at_most signs."""
    texts, a, size = batch.column("text"), 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= at_most:
            yield a, texts.slice(a, i + 1 - a).to_pylist()
            a, size = i + 1, 0
    if a < len(texts):
        yield a, texts.slice(a).to_pylist()


def fit(rows: DataFrame, vocabulary: str | None = None, max_rows: int = 4000, rounds: int = 4) -> Pieces:
    """Learns from rows (lang, text): of each language about max_rows rows with a letter, picked by a hash of the text (all of
    them, and at least one, if it has fewer). Rows with a null are left out. All words of these rows count."""
    rows = rows.select("lang", "text").where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("place", F.expr("pmod(xxhash64(text, 'fit'), 1048576)"))
    picked = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least"))
    picked = picked.selectExpr("lang", f"greatest(least, cast(1048576 * least(1D, {max_rows}D / n) as bigint)) as last").collect()  # one row a language
    languages = sorted(r.lang for r in picked)
    model = Pieces(pieces(vocabulary), languages)
    if not languages:
        return model
    last = F.create_map(*[F.lit(x) for r in picked for x in (r.lang, r.last)])
    rows = rows.where(F.col("place") <= last[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, texts in _groups(batch):
                signs, text, starts, sizes = words_of(texts)
                n: dict[tuple[str, bytes], int] = {}
                for t, s, k in zip(text.tolist(), starts.tolist(), sizes.tolist()):
                    key = (langs[a + t], signs[s : s + k].tobytes())
                    n[key] = n.get(key, 0) + 1
                yield pa.record_batch({"lang": [k[0] for k in n], "word": [k[1].decode("utf-32-le") for k in n], "n": pa.array(n.values(), pa.int64())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double").alias(f"n{i}") for i, x in enumerate(languages)]))
    names = [f"n{i}" for i in range(len(languages))]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = np.zeros_like(model.chance)
        for batch in batches:
            texts = batch.column("word").to_pylist()
            signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            seen += model.expected(signs, np.cumsum(sizes) - sizes, sizes, np.stack([batch.column(c).to_numpy() for c in names], 1))
        used = np.flatnonzero(seen.any(1))
        # whole numbers: their sums don't depend on the order of tasks
        yield pa.record_batch({"piece": pa.array(used, pa.int64()), **{c: pa.array(np.rint(seen[used, i] * 2**20).astype(np.int64)) for i, c in enumerate(names)}})

    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)  # the vocabulary times the languages: about a MB
        sums = words.mapInArrow(expect, ", ".join(["piece long", *[f"{c} long" for c in names]])).groupBy("piece").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        seen = np.zeros_like(model.chance)
        seen[sums.column("piece").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in names], 1) / 2**20
        shared.unpersist()
        model.maximised(seen)
    dropped(words)
    return model


def identify(docs: DataFrame, model: Pieces, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id, unless given) of docs with lang_pred, score (the posterior of lang_pred, all languages equally
    likely before) and letters_score (mean log likelihood of a letter). docs must have a column text."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed vocabulary times the languages: a few MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, known, known_ll = np.array([*model.languages, "und"], object), np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
        for batch in batches:
            for a, texts in _groups(batch):
                signs, text, starts, sizes = words_of(texts)
                total, letters = np.zeros((len(texts), len(model.languages))), np.bincount(text, sizes, len(texts)) if len(text) else np.zeros(len(texts))
                if len(text) and model.languages:
                    distinct, first, where = np.unique(hashed(signs, starts, sizes), return_index=True, return_inverse=True)
                    at = np.searchsorted(known, distinct)
                    have = np.zeros(len(distinct), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == distinct
                    ll = np.zeros((len(distinct), len(model.languages)))
                    ll[have] = known_ll[at[have]]
                    new = np.flatnonzero(~have)
                    by_size = new[np.argsort(sizes[first[new]], kind="stable")]
                    for b in range(0, len(by_size), 8192):
                        rows = by_size[b : b + 8192]
                        ll[rows] = model.likelihoods(padded(signs, starts[first[rows]], sizes[first[rows]]), sizes[first[rows]] + 1)
                    if len(known) < REMEMBERED and len(new):
                        order = np.argsort(hashes := np.concatenate((known, distinct[new])))
                        known, known_ll = hashes[order], np.concatenate((known_ll, ll[new]))[order]
                    for x in range(total.shape[1]):
                        total[:, x] = np.bincount(text, ll[where, x], len(texts))
                none = (letters == 0) | (len(model.languages) == 0)
                best = total.argmax(1) if model.languages else np.zeros(len(texts), int)
                top = total.max(1, initial=-np.inf)
                posterior = np.where(none, 0.0, 1 / np.maximum(np.exp(total - top[:, None]).sum(1), 1.0)) if model.languages else np.zeros(len(texts))
                own = {c: batch.column(c).slice(a, len(texts)) for c in keep}
                yield pa.record_batch(own | {"lang_pred": pa.array(names[np.where(none, len(names) - 1, best)], pa.string()), "score": pa.array(posterior, pa.float64()), "letters_score": pa.array(np.where(none, 0.0, top / np.maximum(letters, 1)), pa.float64())})

    found = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("letters_score", "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, found)
