"""Shared parts: columns kept aside, connected components, and vectorised word hashing for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.functions.stored import dropped
from skysweep.functions.stored import stored as written


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], Callable[..., DataFrame]]:
    """docs with every column but the needed ones under a name of its own, so that none clashes with an operator's; these names in order, and a
    function that gives a result its columns back: those of docs, then the extra ones named."""
    own = {c: c if c in needed else f"col_{i}_" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, *extra: str) -> DataFrame:
        return df.select(*[F.col(k).alias(c) for c, k in own.items()], *extra)

    return docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in own.items()]), list(own.values()), back


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, component) per node, component the smallest node.

    Alternates the large-star and small-star steps; every round is a few aggregations and joins, and its result is a
    written table. Null ends and loops are dropped. An empty input gives an empty output.
    """
    cur = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select("u", F.col("m").alias("v")).distinct()
        old, cur = cur, written(small)
        dropped(old)
        now = cur.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- hashing -------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BY_PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _by_place(n: int) -> np.ndarray:
    """A random 64-bit multiplier for each place in a word."""
    global _BY_PLACE
    if n > len(_BY_PLACE):
        _BY_PLACE = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * _ODD)
    return _BY_PLACE


def hashed_words(data: np.ndarray, ends: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts that lie one after another in data, text i ending at ends[i].

    Returns the words' 64-bit hashes, first bytes and ends, and for each text the number of words up to its end.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[0] = True
    cut[ends] = True
    before = np.concatenate(([False], word[:-1])) & ~cut[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate((word[1:], [False])) & ~cut[1:]
    stops = np.flatnonzero(word & ~after) + 1
    sizes = stops - starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts, stops, np.zeros(len(ends), np.int64)
    chars = data[word]
    chars = (_LOWER[chars] if lower else chars).astype(np.uint64) + np.uint64(1)
    at = np.cumsum(sizes) - sizes
    place = np.arange(len(chars)) - np.repeat(at, sizes)
    hashes = mixed(np.add.reduceat(chars * _by_place(int(sizes.max()))[place], at) + sizes.astype(np.uint64) * _ODD)
    return hashes, starts, stops, np.searchsorted(starts, ends)


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (of one text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mixed(acc)


def blocks(column: pa.Array, at_most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about at_most bytes: first row, last row + 1, bytes, ends of the texts. Null is empty."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + at_most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a]
        a = b
