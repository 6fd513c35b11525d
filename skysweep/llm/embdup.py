"""Near-duplicate embeddings with randomised-rotation binary codes.

A vector is scaled to length 1 and rotated at random; its code is the signs, kept with the correction factor that makes the inner-product estimate from the code unbiased,
and with it a bound on the estimate's error.

1. Equal vectors of one label form a class.
2. Signs of products with random normal directions are the keys of hash tables per label. No two bits of any table share a direction, so all bits are independent, and there
   are as many tables as give a pair at the threshold a chance under MISS to share none.
3. In each bucket all classes are compared with the smallest one. Those within half the threshold's angle join its ball: by the
   triangle inequality all vectors of a ball are linked, and need no comparison.
4. Balls that share a bucket are compared; those of a bucket of more than SMALL in blocks, by estimates alone at first. Estimates whose upper confidence bound lies below what a link needs end a pair; the others are computed exactly, and the triangle
   inequality settles most of them for all their vectors. What stays open is computed exactly for each vector.

Every link counts, in both directions, without writing out the pairs of a group. Null labels and vectors that are null, zero, or hold
null or non-finite components link with nothing. Shorter vectors are filled up with zeros. Rows that repeat an id are vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import components, mixed, written
from skysweep.llm.topk import FINITE

MISS, CODE = 1e-6, 256
#: Key bits worked out at once.
STEP = 4096
#: Standard deviations in an estimate's confidence bound.
DEVIATIONS = 6.0
#: Balls of a bucket up to which its pairs are written out, and balls in a block of a larger bucket.
SMALL, BLOCK = 32, 2048
#: Angles closer than this to a decision are settled by exact cosines.
SLACK = 1e-6


def rotations(width: int, seed: int = 7) -> np.ndarray:
    """(width, CODE): random rotations side by side, each orthonormal."""
    rng, out = np.random.default_rng(seed), []
    while sum(x.shape[1] for x in out) < CODE:
        out.append(np.linalg.qr(rng.standard_normal((max(1, width), max(1, width))))[0])
    return np.concatenate(out, 1)[:, :CODE]


def table_keys(unit: np.ndarray, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    """(vectors, tables): the sign bits of each table, every bit with a direction of its own."""
    out, step = np.empty((len(unit), tables), np.uint64), max(1, STEP // bits)
    for a in range(0, tables, step):
        n = min(step, tables - a)
        directions = np.random.default_rng((seed, a)).standard_normal((unit.shape[1], n * bits))
        signs = (unit @ directions > 0).reshape(len(unit), n, bits)
        out[:, a : a + n] = (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(2)
    return out


def coded(unit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the CODE rotated components, these components as a vector of length 1, and the correction factors."""
    turned = unit @ rotation
    code = turned / np.maximum(np.linalg.norm(turned, axis=1), 1e-300)[:, None]
    return turned > 0, code, np.abs(code).sum(1) / math.sqrt(CODE)


def estimated(rotated: np.ndarray, signs: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rotated vectors with vectors known by signs (+-1) and factor, and the bounds on their errors."""
    value = (rotated * signs).sum(1) / math.sqrt(CODE) / factor
    return value, DEVIATIONS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(CODE - 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _exact(pairs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """pairs (a, b, ...) with cosine, the exact one of their vectors."""
    both = pairs.join(classes.selectExpr("cid as a", "unit as ua"), "a").join(classes.selectExpr("cid as b", "unit as ub"), "b")

    columns = pairs.columns

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = (_matrix(batch.column("ua"), width) * _matrix(batch.column("ub"), width)).sum(1)
                yield batch.select(columns).append_column("cosine", pa.array(c))

    return both.select(*pairs.columns, "ua", "ub").mapInArrow(cosine, pairs.withColumn("cosine", F.lit(0.0)).schema)


def _unsettled(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b, need) whose estimate may reach the cosine need."""
    both = pairs.join(classes.selectExpr("cid as a", "rotated as va"), "a").join(classes.selectExpr("cid as b", "code as cb", "factor as fb"), "b")

    columns = pairs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a = np.frombuffer(b"".join(batch.column("va").to_pylist()), np.float32).reshape(-1, CODE)
                bits = np.unpackbits(np.frombuffer(b"".join(batch.column("cb").to_pylist()), np.uint8).reshape(-1, CODE // 8), axis=1)
                value, error = estimated(a, bits * 2.0 - 1, batch.column("fb").to_numpy())
                yield batch.select(columns).filter(pa.array(value + error >= batch.column("need").to_numpy()))

    return both.select(*pairs.columns, "va", "cb", "fb").mapInArrow(keep, pairs.schema)


def _in_blocks(left: DataFrame, balls: DataFrame, classes: DataFrame, theta: float) -> DataFrame:
    """Pairs (a, b) of balls (key, ball, c) that share a bucket, c balls in all, and whose estimate may reach what a link needs. A bucket's balls are dealt to blocks of about BLOCK;
    a task compares one pair of blocks at a time."""
    dealt = left.selectExpr("key", "ball", f"c div {BLOCK} + 1 as wide").withColumn("x", F.expr("pmod(xxhash64(ball), wide)"))
    dealt = dealt.withColumn("y", F.explode(F.expr("sequence(0L, wide - 1)"))).selectExpr("key", "least(x, y) as lo", "greatest(x, y) as hi", "int(x > y) as kind", "ball")
    known = balls.select("ball", "r").join(classes.selectExpr("cid as ball", "rotated", "code", "factor"), "ball")
    group = ["key", "lo", "hi"]
    rows = dealt.join(known, "ball").select(*group, "kind", "ball", "r", "rotated", "code", "factor").repartition(*group).sortWithinPartitions(*group, "kind")

    def near(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, r, factor, kind = (table.column(c).to_numpy() for c in ("ball", "r", "factor", "kind"))
        rotated = np.frombuffer(b"".join(table.column("rotated").to_pylist()), np.float32).reshape(-1, CODE)
        bits = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, CODE // 8), axis=1)
        signs = bits.astype(np.float32) * 2 - 1
        error = DEVIATIONS * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(CODE - 1)
        alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        some, others = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(kind == 0), np.flatnonzero(kind == 1))
        for i in range(0, len(some), 512):
            p = some[i : i + 512]
            value = rotated[p] @ signs[others].T / math.sqrt(CODE) / factor[others]
            need = np.cos(np.minimum(math.pi, theta + r[p][:, None] + r[others][None, :] + SLACK))
            x, y = np.nonzero((value + error[others] >= need) & ((ids[p][:, None] < ids[others][None, :]) | (not alone)))
            a, b = ids[p[x]], ids[others[y]]
            if len(a):
                yield pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in group])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(keys[:, a].tolist())
                if this != now:
                    yield from near(held) if held else ()
                    now, held = this, []
                held.append(batch.slice(a, b - a))
        yield from near(held) if held else ()

    return rows.mapInArrow(compare, "a long, b long")


def table_sizes(classes: int, threshold: float = 0.93, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and tables, for so many classes in the largest label."""
    bits = min(40, max(12, math.ceil(math.log2(max(2, classes))) + 3))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-alike))


def near_duplicates(rows: DataFrame, threshold: float = 0.93, miss: float = MISS) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    usable = f"label is not null and {FINITE} and exists(embedding, x -> x <> 0)"
    rows = rows.selectExpr("vec_id", f"case when {usable} then xxhash64(label, embedding) end as cid", "label", "embedding")
    grouped = rows.where("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    shape = grouped.groupBy("label").agg(F.count("*").alias("c"), F.max(F.size("embedding")).alias("d")).agg(F.max("c").alias("c"), F.max("d").alias("d")).first()
    width = shape.d or 1
    bits, tables = table_sizes(shape.c or 2, threshold, miss)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = rotations(width)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                lists = part.column("embedding")
                table = np.zeros((len(lists), width))
                table[np.arange(width)[None, :] < lists.value_lengths().to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy()
                table /= np.abs(table).max(1)[:, None]
                unit = table / np.linalg.norm(table, axis=1)[:, None]
                signs, code, factor = coded(unit, rotation)
                keys = table_keys(unit, tables, bits) ^ part.column("label").to_numpy().view(np.uint64)[:, None]
                keys = mixed(keys + mixed(np.arange(1, tables + 1, dtype=np.uint64))[None, :]).view(np.int64)
                bits_ = np.packbits(signs, axis=1)
                yield pa.record_batch({"cid": part.column("cid"), "n": part.column("n"), "least": part.column("least"), "unit": pa.array([x.tobytes() for x in unit], pa.binary()), "rotated": pa.array([x.tobytes() for x in code.astype(np.float32)], pa.binary()), "code": pa.array([x.tobytes() for x in bits_], pa.binary()), "factor": pa.array(factor, pa.float64()), "keys": pa.array(list(keys), pa.list_(pa.int64()))})

    form = f"cid long, n long, least {rows.schema['vec_id'].dataType.simpleString()}, unit binary, rotated binary, code binary, factor double, keys array<long>"
    classes = written(grouped.select("cid", "n", "least", F.xxhash64("label").alias("label"), "embedding").mapInArrow(sketch, form))
    theta = math.acos(threshold)

    keyed = classes.select(F.explode("keys").alias("key"), "cid")
    shared = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("cid").alias("first")).where("c > 1").drop("c")
    met = written(keyed.join(shared, "key"))
    star = met.where("cid > first").selectExpr("first as a", "cid as b").distinct().withColumn("need", F.lit(math.cos(theta / 2 - SLACK)))
    star = written(_exact(_unsettled(star, classes), classes, width).where("cosine >= need"))
    roots = star.select(F.col("b").alias("a")).distinct()
    inside = star.join(roots, "a", "left_anti").groupBy("b").agg(F.min_by(F.struct("a", "cosine"), "a").alias("x")).selectExpr("b as cid", "x.a as ball", "acos(least(1D, x.cosine)) as angle")
    members = classes.select("cid", "n", "least").join(inside, "cid", "left").selectExpr("cid", "n", "least", "coalesce(ball, cid) as ball", "coalesce(angle, 0D) as angle")
    members = written(members)
    balls = written(members.groupBy("ball").agg(F.sum("n").alias("n"), F.max("angle").alias("r"), F.min("least").alias("least")))

    # pairs of balls that share a bucket: all of a small bucket, of a large one those that an estimate leaves open
    left = written(met.join(members.select("cid", "ball"), "cid").select("key", "ball").distinct())
    left = written(left.join(left.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"))
    small = left.where(f"c <= {SMALL}")
    found = small.selectExpr("key", "ball as a").join(small.selectExpr("key", "ball as b"), "key").where("a < b").select("a", "b")
    pairs = written(found.unionByName(_in_blocks(left.where(f"c > {SMALL}"), balls, classes, theta)).distinct())
    sized = pairs.join(balls.selectExpr("ball as a", "n as na", "r as ra"), "a").join(balls.selectExpr("ball as b", "n as nb", "r as rb"), "b")
    sized = sized.withColumn("need", F.expr(f"cos(least(pi(), {theta!r}D + ra + rb + {SLACK}D))"))
    phi = F.expr("acos(greatest(-1D, least(1D, cosine)))")
    met_balls = written(_exact(_unsettled(sized, classes), classes, width).withColumn("phi", phi))
    # two single classes: their cosine decides; else the triangle inequality, where it can
    state = f"case when ra + rb = 0 then if(cosine >= {threshold!r}D, 'all', 'none') when phi - ra - rb > {theta!r}D + {SLACK}D then 'none' when phi + ra + rb < {theta!r}D - {SLACK}D then 'all' else 'some' end"
    met_balls = met_balls.withColumn("state", F.expr(state))
    whole = met_balls.where("state = 'all'")
    for_ball = whole.selectExpr("a as ball", "nb as more").unionByName(whole.selectExpr("b as ball", "na as more"))
    edges = whole.selectExpr("a as u", "b as v")
    some = met_balls.where("state = 'some'").select("a", "b", "nb", "rb").withColumnRenamed("a", "home")
    some = some.join(members.selectExpr("ball as home", "cid as a", "n as na"), "home")
    some = written(_exact(some, classes, width).withColumn("phi", phi).withColumn("state", F.expr(state.replace("ra + rb", "rb").replace("- ra", "").replace("+ ra", ""))))
    whole = some.where("state = 'all'")
    for_ball = for_ball.unionByName(whole.selectExpr("b as ball", "na as more"))
    for_class = whole.selectExpr("a as cid", "nb as more")
    edges = edges.unionByName(whole.selectExpr("home as u", "b as v"))
    single = some.where("state = 'some'").selectExpr("home", "a", "na", "b as away").join(members.selectExpr("ball as away", "cid as b", "n as nb"), "away")
    single = written(_exact(single, classes, width).where(f"cosine >= {threshold!r}D"))
    for_class = for_class.unionByName(single.selectExpr("a as cid", "nb as more")).unionByName(single.selectExpr("b as cid", "na as more"))
    edges = edges.unionByName(single.selectExpr("home as u", "away as v"))

    labels = components(edges)
    named = balls.join(labels.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.expr("coalesce(component, ball)"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "component").join(for_ball.groupBy("ball").agg(F.sum("more").alias("more")), "ball", "left").selectExpr("ball", "component_id", "n - 1 + coalesce(more, 0L) as links")
    of_class = members.select("cid", "ball").join(named, "ball").join(for_class.groupBy("cid").agg(F.sum("more").alias("more")), "cid", "left").selectExpr("cid", "component_id", "links + coalesce(more, 0L) as links")
    out = rows.select("vec_id", "cid").join(of_class, "cid", "left")
    return out.selectExpr("vec_id", "coalesce(links, 0L) as n_links", "coalesce(component_id, vec_id) as component_id").withColumn("kept", F.expr("vec_id <=> component_id"))


ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select x, count(*) n_links from l group by x),
r(x, y) as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
m as (select x, min(y) y from r group by x)
select vec_id, coalesce(n_links, 0) n_links, least(vec_id, coalesce(m.y, vec_id)) component_id, vec_id = least(vec_id, coalesce(m.y, vec_id)) kept
from embeddings left join n on vec_id = n.x left join m on vec_id = m.x
"""
