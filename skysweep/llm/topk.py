"""Exact top-k by inner product over integer vectors, with an impact-ordered index read score at a time.

Vectors are dealt to blocks by a hash of their id. A block's index holds, for each dimension, its vectors by value, so the
postings whose impact (query component times value) lies in one quantised level are one segment. A query reads the segments level by
level, highest impact first; a vector's upper bound is the upper ends of its read levels plus the present level's lower end for
each dimension not read. The best vectors so far are scored exactly; reading stops when the bounds prove that all but few
vectors lie below the k-th best of these, and the rest are scored exactly. Blocks' results are merged.

Every query meets every block: the queries are a stated part of the rows. Rows with one id count once, the greatest vector; null ids, null
vectors and vectors with null or non-finite components take no part. Shorter vectors are filled up with zeros. Equal scores go to the smaller id. Vectors whose products could leave 64 bits are refused by a ValueError. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Lower ends of the impact levels, as parts of the largest impact.
LEVELS = 0.72 ** np.arange(1, 15)
FINITE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


class Block:
    """Vectors of one block by dimension and value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[by_id], vectors[by_id]
        values = self.exact.astype(np.float64)
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        sorted_ = np.take_along_axis(values.T, self.order, 1)
        self.low, self.high = sorted_[:, 0], sorted_[:, -1]
        self.step = 4 * (np.abs(values).max(initial=0) + 1)
        self.flat = (sorted_ + self.step * np.arange(len(sorted_))[:, None]).ravel()

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors but those with id own."""
        n, d = self.exact.shape
        q = query.astype(np.float64)
        most = np.where(q > 0, q * self.high, q * self.low)
        used = np.flatnonzero(most > 0)
        bound, read, chosen = np.zeros(n), np.zeros(n, np.int64), None
        own_row = self.ids == own
        if len(used) and n > 4 * k:
            edges = most.max() * np.concatenate(([1.0], LEVELS))
            # from the highest impact down, a segment's first posting: from the right if the component is positive
            cuts = np.clip(edges[None, :] / q[used, None], -self.step / 3, self.step / 3) + self.step * used[:, None]
            at = np.where(q[used, None] > 0, np.searchsorted(self.flat, cuts.ravel(), "left").reshape(cuts.shape), np.searchsorted(self.flat, cuts.ravel(), "right").reshape(cuts.shape))
            at = np.clip(at - (used * n)[:, None], 0, n)
            up = q[used] > 0
            at[:, 0] = np.where(up, n, 0)
            for level in range(len(LEVELS)):
                lo, hi = np.minimum(at[:, level], at[:, level + 1]), np.maximum(at[:, level], at[:, level + 1])
                parts = [self.order[x, a:b] for x, a, b in zip(used.tolist(), lo.tolist(), hi.tolist()) if b > a]
                if parts:
                    counts = np.bincount(np.concatenate(parts), minlength=n)
                    bound += counts * edges[level]
                    read += counts
                if level < 4:
                    continue
                upper = bound + (len(used) - read) * edges[level + 1]
                upper[own_row] = -np.inf
                top = np.argpartition(-upper, k + 8)[: k + 9]
                floor = np.sort(self.exact[top[~own_row[top]]] @ query)[-k]
                chosen = np.flatnonzero(upper * (1 + 1e-9) + 1e-6 >= floor)
                if len(chosen) <= max(64, n // 32):
                    break
        chosen = np.arange(n) if chosen is None else chosen
        chosen = chosen[~own_row[chosen]]
        scores = self.exact[chosen] @ query
        first = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen[first]], scores[first]


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of the rows that take part, one row an id."""
    v = f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))"
    return rows.where(f"vec_id is not null and {FINITE}").selectExpr("vec_id", f"{v} as v").groupBy("vec_id").agg(F.max("v").alias("v"))


def fitting(rows: DataFrame) -> Row:
    """n, the rows of (vec_id, v), and d, the longest vector; a ValueError if an inner product may not fit into 64 bits."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.expr("max(greatest(abs(cast(array_max(v) as double)), abs(cast(array_min(v) as double))))").alias("most")).first()
    if shape.n and (shape.most or 0.0) ** 2 * (shape.d or 0) >= 2.0**63:
        raise ValueError(f"components up to {shape.most:.0f} in {shape.d} dimensions: scores would leave 64 bits")
    return shape


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, least_block: int = 4096, most_block: int = 65536) -> DataFrame:
    """For each of queries (vec_id, v) its k best of rows (vec_id, v) with another id: query_id, rank, vec_id, score. About 1/64 of the rows
    make a block, between the two bounds."""
    shape = fitting(rows)
    blocks = max(1, -(-shape.n // min(most_block, max(least_block, shape.n // 64))))
    width = shape.d or 0
    dealt = rows.selectExpr("vec_id", "v", f"pmod(xxhash64(vec_id), {blocks}) as block", "0 as kind").unionByName(
        queries.selectExpr("vec_id", "v", f"explode(sequence(0L, {blocks - 1}L)) as block", "1 as kind")
    )
    dealt = dealt.repartition(min(blocks, 20_000), "block").sortWithinPartitions("block", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, index = None, [], [], None
        for batch in batches:
            all_ids, keys, kinds = (batch.column(c).to_numpy() for c in ("vec_id", "block", "kind"))
            lists = batch.column("v")
            sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            table = np.zeros((len(all_ids), width), np.int64)
            table[np.arange(width)[None, :] < sizes[:, None]] = flat
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != now:
                    now, ids, vectors, index = keys[a], [], [], None
                if kinds[a] == 0:
                    ids.append(all_ids[a:b])
                    vectors.append(table[a:b])
                    continue
                if not ids:
                    continue
                index = index or Block(np.concatenate(ids), np.concatenate(vectors))
                found = [(int(all_ids[i]), *index.best(all_ids[i], table[i], k)) for i in range(a, b)]
                out = {"query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64), "vec_id": np.concatenate([x[1] for x in found]).astype(np.int64), "score": np.concatenate([x[2] for x in found]).astype(np.int64)}
                yield pa.record_batch(out)

    found = dealt.select("vec_id", "v", "block", "kind").mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


ORACLE = """
with a as (select vec_id, max(list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint score
  from a q join a c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s
qualify rank <= 5
"""
