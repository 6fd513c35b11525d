"""Hard negatives by inner product, found exactly with an inverted multi-index.

Vectors are cut into two halves; each half has a codebook, fitted by k-means on a bounded sample, and the two nearest codewords of a vector name its cell. A half's score
with a query is at most the query's product with the codeword plus its length times the codeword's radius (the largest distance of a member's half); the
sum of both halves bounds every vector of a cell. Cells are dealt to blocks in order; a cell too large for a block is cut by a hash of the ids.

An anchor first visits the block that it lies in. The scores found there are its floor: of the other blocks it goes only to those with a cell whose
bound reaches the floor. In a block a heap gives the cells in the order of their bounds (multi-sequence: pairs of the two halves' codewords, best sums first), and the visit stops
when the next bound lies below the floor of everything asked for. Anchors of a block are dealt to several tasks if they are many. First the positives are found
(the best rows of the anchor's label), then, for each positive's score p, the best rows of other labels in the window low * p <= 100 * score <= high * p. Cells that lie above all
windows are not scored. All scores are exact whole numbers; bounds carry a margin for rounding.

Rows with one vec_id count once (the greatest vector, then label); rows with a null id, label or vector, or a null or non-finite component take no part. Shorter vectors are filled up with
zeros. Equal scores go to the smaller id. Vectors whose products could leave 64 bits are refused by a ValueError. An empty table gives an empty result. Extra
columns are not looked at. Labels are whole numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import dropped, written
from skysweep.llm.topk import FINITE, fitting

#: Rows of the sample for each codeword, rounds of k-means, the most codewords of a half.
SAMPLED, ROUNDS, MOST_WORDS = 64, 8, 256
#: Rows that a visit scores at once, and anchors that one task of a block takes.
AT_ONCE, ANCHORS = 512, 16_384
#: Margin of the bounds, relative to the lengths' product.
MARGIN = 1e-9
_MOST = (1 << 63) - 1


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component x, of the rows that take part, one row an id."""
    v = f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))"
    rows = rows.where(f"vec_id is not null and label is not null and {FINITE}").selectExpr("vec_id", f"struct({v} as v, cast(label as bigint) as label) as x")
    return rows.groupBy("vec_id").agg(F.max("x").alias("x")).selectExpr("vec_id", "x.label", "x.v")


def table_of(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def codebook(points: np.ndarray, words: int) -> np.ndarray:
    """Codewords of the points by k-means."""
    random = np.random.default_rng(7)
    distinct = np.unique(points, axis=0)
    words = max(1, min(words, len(distinct)))
    centres = distinct[random.permutation(len(distinct))[:words]].astype(float) if len(distinct) else np.zeros((1, points.shape[1]))
    for _ in range(ROUNDS):
        own = nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        for k in np.flatnonzero(n):
            centres[k] = points[own == k].mean(0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (points @ centres.T)).argmin(1) if len(points) else np.zeros(0, np.int64)


class Cells:
    """The vectors of one block by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, words: np.ndarray, books: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((ids, words[:, 1], words[:, 0]))
        self.ids, self.labels, words = ids[order], labels[order], words[order]
        vectors, half = vectors[order], books[0].shape[1]
        self.vectors = vectors.astype(np.float64) if float(np.abs(vectors).max(initial=0)) ** 2 * vectors.shape[1] < 2**52 else vectors  # whole numbers either way
        self.halves = []
        for side, part in enumerate((vectors[:, :half], vectors[:, half:])):
            own, at = np.unique(words[:, side], return_inverse=True)
            far = np.sqrt(((part - books[side][words[:, side]]) ** 2).sum(1))
            radius = np.zeros(len(own))
            np.maximum.at(radius, at, far)
            self.halves.append((books[side][own], radius, at))
        cell = self.halves[0][2] * len(self.halves[1][0]) + self.halves[1][2]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.spans = dict(zip(cell[starts].tolist(), zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist(), strict=True), strict=True))

    def visits(self, query: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """Cells by falling upper bound: upper and lower bound of their scores, first row, last row + 1."""
        half = self.halves[0][0].shape[1]
        scores, slack = [], []
        for (centres, radius, _), q in zip(self.halves, (query[:half], query[half:]), strict=True):
            scores.append(centres @ q)
            slack.append(np.sqrt((q**2).sum()) * radius)
        margin = MARGIN * (1 + sum(float(np.abs(s).max() + t.max()) for s, t in zip(scores, slack, strict=True)))
        order = [np.argsort(-(s + t), kind="stable").tolist() for s, t in zip(scores, slack, strict=True)]
        upper = [(s + t)[o].tolist() for s, t, o in zip(scores, slack, order, strict=True)]
        lower = [(s - t)[o].tolist() for s, t, o in zip(scores, slack, order, strict=True)]
        n, m = len(order[0]), len(order[1])
        heap, spans = [(-(upper[0][0] + upper[1][0]), 0, 0)], self.spans
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < m:  # every pair (i, j) comes from (i, j - 1), and (i, 0) from (i - 1, 0)
                heapq.heappush(heap, (-(upper[0][i] + upper[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < n:
                heapq.heappush(heap, (-(upper[0][i + 1] + upper[1][0]), i + 1, 0))
            span = spans.get(order[0][i] * m + order[1][j])
            if span:
                yield -bound + margin, lower[0][i] + lower[1][j] - margin, *span

    def best(self, own: int, label: int, query: np.ndarray, k: int, windows: list[tuple[int, int]] | None, floors: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Without windows: ids and scores of the k best rows of the label but the row own. With windows (from, to), of the k best rows of other labels in each. floors: one for each result,
        a score known to be reached k times elsewhere."""
        if windows is None:
            windows, same = [(-_MOST, _MOST)], True
        else:
            same = False
        floors = [max(a, f) if a <= b else _MOST for (a, b), f in zip(windows, floors, strict=True)]  # nothing lies in a window that ends before it begins
        top = max(b for _, b in windows)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        query_ = query.astype(self.vectors.dtype)
        spans, held = [], 0
        visits = self.visits(query.astype(float))
        while True:
            step = next(visits, None)
            over = step is None or step[0] < min(floors)
            if not over and step[1] <= top:
                spans.append(step[2:])
                held += step[3] - step[2]
            if spans and (over or held >= AT_ONCE):
                rows = np.concatenate([np.arange(a, b) for a, b in spans])
                rows = rows[(self.labels[rows] == label) == same]
                rows = rows[self.ids[rows] != own]
                scores = (self.vectors[rows] @ query_).astype(np.int64)
                for w, (a, b) in enumerate(windows):
                    good = (scores >= max(a, floors[w])) & (scores <= b)
                    ids, values = np.concatenate((found[w][0], self.ids[rows[good]])), np.concatenate((found[w][1], scores[good]))
                    first = np.lexsort((ids, -values))[:k]
                    found[w] = ids[first], values[first]
                    if len(first) == k:
                        floors[w] = max(floors[w], int(values[first[-1]]))
                spans, held = [], 0
                over = over or step[0] < min(floors)
            if over:
                return found


class Index:
    """rows (vec_id, label, v) by cell, dealt to blocks: a stored table, the codebooks, and the cells of each block with their radii."""

    def __init__(self, rows: DataFrame, least_block: int = 2048, most_block: int = 65_536):
        rows = written(rows)
        shape = fitting(rows)
        self.n, self.width = shape.n, shape.d or 0
        half = self.width // 2
        words = int(min(MOST_WORDS, max(4, (self.n / 16) ** 0.5)))
        sample = table_of(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED * words).select("v").toArrow().column("v").combine_chunks(), self.width).astype(float)
        self.books = books = codebook(sample[:, :half], words), codebook(sample[:, half:], words)
        width = self.width

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = table_of(batch.column("v"), width)
                out = {c: batch.column(c) for c in ("vec_id", "label", "v")}
                for side, part in enumerate((table[:, :half], table[:, half:])):
                    own = nearest(part, books[side])
                    out |= {f"c{side}": pa.array(own, pa.int32()), f"r{side}": pa.array(np.sqrt(((part - books[side][own]) ** 2).sum(1)), pa.float64())}
                yield pa.record_batch(out)

        cells = written(rows.mapInArrow(placed, "vec_id long, label long, v array<long>, c0 int, r0 double, c1 int, r1 double"))
        counts = cells.groupBy("c0", "c1").agg(F.count("*").alias("n")).toPandas().sort_values(["c0", "c1"])  # MOST_WORDS squared rows at most
        block = max(1, min(most_block, max(least_block, self.n // 64)))
        first, parts, at, filled = [], [], -1, block
        for n in counts["n"]:
            if n >= block or filled + n > block:
                at, filled = at + 1, 0
            first.append(at)
            parts.append(max(1, -(-n // block)))
            filled += n
            if parts[-1] > 1:
                at, filled = at + parts[-1] - 1, block
        self.blocks = at + 1
        counts["first"], counts["parts"] = first, parts
        where = rows.sparkSession.createDataFrame(counts[["c0", "c1", "first", "parts"]].astype("int64"), "c0 long, c1 long, first long, parts long")
        self.rows = written(cells.join(F.broadcast(where), ["c0", "c1"]).selectExpr("vec_id", "label", "v", "c0", "c1", "r0", "r1", "first + pmod(xxhash64(vec_id), parts) as block"))
        radii = self.rows.groupBy("block", "c0", "c1").agg(F.max("r0").alias("r0"), F.max("r1").alias("r1")).toPandas().sort_values(["block", "c0", "c1"])  # cells, and a row more for each further block of a large one
        self.cells = {c: radii[c].to_numpy() for c in radii.columns}
        dropped(rows, cells)

    def routed(self, anchors: DataFrame, home: bool) -> DataFrame:
        """anchors (vec_id, label, v, block, scores, floors) with the blocks to visit: their own, or the others whose bound reaches their least floor."""
        if home:
            return anchors
        books, cells, width, half = self.books, self.cells, self.width, self.width // 2
        starts = np.flatnonzero(np.diff(cells["block"], prepend=-1))
        blocks = cells["block"][starts]

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = table_of(batch.column("v"), width).astype(float)
                own, floors = batch.column("block").to_numpy(), batch.column("floors").to_pylist()
                for i in range(len(table)):
                    q0, q1 = table[i, :half], table[i, half:]
                    score = (books[0] @ q0)[cells["c0"]] + (books[1] @ q1)[cells["c1"]]
                    slack = np.sqrt((q0**2).sum()) * cells["r0"] + np.sqrt((q1**2).sum()) * cells["r1"]
                    bound = np.maximum.reduceat(score + slack, starts)
                    bound += MARGIN * (1 + np.abs(score).max() + slack.max())
                    to = blocks[(bound >= min(floors[i])) & (blocks != own[i])]
                    one = batch.slice(i, 1).take(pa.array(np.zeros(len(to), np.int64)))
                    yield one.set_column(one.schema.get_field_index("block"), "block", pa.array(to, pa.int64()))

        return anchors.mapInArrow(route, anchors.schema)

    def search(self, targets: DataFrame, k: int, low: int | None, high: int | None) -> DataFrame:
        """targets (vec_id, label, v, block, scores, floors) against their blocks: anchor_id, place (of the score that the window comes from), vec_id, score. low and high: the window in hundredths of a score; None
        for the rows of the anchor's own label."""
        targets = written(targets)
        many = targets.groupBy("block").agg((F.count("*") / ANCHORS).alias("n")).selectExpr("block", "cast(ceil(n) as int) as tasks")  # a row a block
        rows = self.rows.join(F.broadcast(many), "block").selectExpr("block", "explode(sequence(0, tasks - 1)) as task", "0 as kind", "vec_id", "label", "v", "c0", "c1", "cast(null as array<long>) as scores", "cast(null as array<long>) as floors")
        asked = targets.join(F.broadcast(many), "block").selectExpr("block", "cast(pmod(xxhash64(vec_id), tasks) as int) as task", "1 as kind", "vec_id", "label", "v", "0L as c0", "0L as c1", "scores", "floors")
        dealt = rows.unionByName(asked).repartition(max(1, min(self.blocks, 20_000)), "block", "task").sortWithinPartitions("block", "task", "kind")
        books, width = self.books, self.width

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, cells = None, [], None
            for batch in batches:
                block, task, kind, ids, labels = (batch.column(c).to_numpy() for c in ("block", "task", "kind", "vec_id", "label"))
                words = np.stack([batch.column(c).to_numpy() for c in ("c0", "c1")], 1)
                table = table_of(batch.column("v"), width)
                cuts = np.flatnonzero(np.any(np.diff(np.stack((block, task, kind)), axis=1) != 0, axis=0)) + 1
                scores, floors = batch.column("scores"), batch.column("floors")
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                    if a == b:
                        continue
                    if (block[a], task[a]) != now:
                        now, held, cells = (block[a], task[a]), [], None
                    if kind[a] == 0:
                        held.append((ids[a:b], labels[a:b], table[a:b], words[a:b]))
                        continue
                    cells = cells or Cells(*(np.concatenate(x) for x in zip(*held, strict=True)), books)
                    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
                    for i in range(a, b):
                        windows = None if low is None else [(-(-low * p // 100), high * p // 100) for p in scores[i].as_py()]
                        found = cells.best(ids[i], labels[i], table[i], k, windows, floors[i].as_py())
                        out += [(int(ids[i]), w, *x) for w, x in enumerate(found) if len(x[0])]
                    sizes = [len(x[2]) for x in out]
                    columns = {"anchor_id": np.repeat([x[0] for x in out], sizes).astype(np.int64), "place": np.repeat([x[1] for x in out], sizes).astype(np.int32)}
                    columns |= {c: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in out)]) for i, c in ((2, "vec_id"), (3, "score"))}
                    yield pa.record_batch(columns)

        return dealt.select("block", "task", "kind", "vec_id", "label", "v", "c0", "c1", "scores", "floors").mapInArrow(visit, "anchor_id long, place int, vec_id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place, with their rank."""
    return found.withColumn("rank", F.expr("row_number() over (partition by anchor_id, place order by score desc, vec_id)")).where(f"rank <= {k}")


#: The least floor: every score reaches it.
_NONE = f"{-_MOST}L"


def _both_rounds(index: Index, anchors: DataFrame, k: int, windows: str | None, low: int | None, high: int | None) -> DataFrame:
    """The k best of each anchor (and window), from its own block and then from the others that may hold better ones."""
    start = anchors.withColumn("floors", F.expr(f"transform(scores, s -> {windows})" if windows else f"array({_NONE})"))
    near = written(index.search(index.routed(start, True), k, low, high))
    reached = near.groupBy(F.col("anchor_id").alias("vec_id"), "place").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(f"n = {k}")
    reached = reached.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("_known"))  # as many entries as an anchor has windows
    further = start.join(reached, "vec_id", "left").withColumn("floors", F.expr("transform(floors, (f, i) -> greatest(f, coalesce(_known[i], f)))")).drop("_known")
    return first(near.unionByName(index.search(index.routed(further, False), k, low, high)), k)


def hard_negatives(rows: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, least_block: int = 2048, most_block: int = 65_536) -> DataFrame:
    """For each row (vec_id, label, v) that the predicate anchors picks, and each of its best positives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = Index(rows, least_block, most_block)
    chosen = written(index.rows.where(anchors).select("vec_id", "label", "v", "block", F.expr("cast(array() as array<long>)").alias("scores")))
    good = written(_both_rounds(index, chosen, positives, None, None, None))
    scores = good.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))  # `positives` of them at most
    asked = written(chosen.drop("scores").join(scores, "vec_id").select("vec_id", "label", "v", "block", "scores"))
    bad = _both_rounds(index, asked, negatives, f"if(s < 0, {_MOST}L, -((-{low} * s) div 100))", low, high)  # a floor may lie under the window's edge by rounding, not above it
    pairs = good.selectExpr("anchor_id", "rank - 1 as place", "vec_id as positive_id", "score as positive_score")
    return bad.join(pairs, ["anchor_id", "place"]).selectExpr("anchor_id", "positive_id", "rank", "vec_id as negative_id", "positive_score", "score as negative_score")


ORACLE = """
with a as (select vec_id, max({'v': list_transform(embedding, lambda x: floor(256 * x::double)::bigint), 'label': (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint}) x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
s as (select q.vec_id anchor_id, c.vec_id, q.x.label = c.x.label same, list_inner_product(q.x.v::double[], c.x.v::double[])::bigint score
  from a q join a c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id positive_id, (row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id))::int rank, n.vec_id negative_id, p.score positive_score, n.score negative_score
from p join s n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
qualify rank <= 3
"""
