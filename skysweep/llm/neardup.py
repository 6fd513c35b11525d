"""MinHash near-duplicates with HyperMinHash sketches.

A text's words are runs of other signs than blanks, A-Z in lower case; its set is its distinct k-word shingles (with fewer words, the whole sequence as one), as 64-bit hashes. Each of REGISTERS
buckets of a sketch keeps its smallest hash as a leading-zero count and MANTISSA bits (16 bits a register).

1. Texts with equal sets form a class, whose smallest id stands for it.
2. Bands of registers (empty ones borrow from full ones at random places) put classes into band groups. There are so many registers to a band that a pair at the
   threshold shares none of the BANDS groups with a chance of MISS at most: 7 at 0.85 (2e-7), 5 at 0.8 (1.3e-7).
3. Quick rounds: each class tries one other class of its groups, first the smallest. The collision-corrected Jaccard estimate
   of the registers drops pairs far below the threshold; the others are confirmed on their full sets, and confirmed links are joined to components.
4. Groups whose members are not yet connected make clusters. The members outside a cluster's largest component are compared with
   all members of other components that share a group with them: by estimate, then on full sets. Members are dealt to blocks of about
   BLOCK_BYTES, and a task compares one pair of blocks and puts out only the links that connect something, never the pairs.

Null texts and texts without words have an empty set and no link. Rows with one id share one entry, with the links of all their texts. Null ids are kept, without a component. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import blocks, components, dropped, hashed_words, mixed, sequences, written

BANDS, REGISTERS, MANTISSA, MISS = 40, 280, 10, 2e-7
#: Quick rounds after the first, and bytes of sets in a block of a cluster.
QUICK, BLOCK_BYTES = 1, 8 << 20
_EMPTY = np.uint16(0xFFFF)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes, in order."""
    return np.unique(sequences(hashes, min(k, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set: 6 bits of leading zeros and MANTISSA bits of the smallest hash in each bucket."""
    out = np.full(REGISTERS, _EMPTY, np.uint16)
    bucket = ((found >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)  # rises with the hash
    first = np.flatnonzero(np.diff(bucket, prepend=np.uint64(REGISTERS)))
    low = np.minimum.reduceat(mixed(found), first)
    zeros = 63 - np.minimum(np.floor(np.log2(np.maximum(low, 1).astype(np.float64))), 63).astype(np.int64)
    zeros = np.minimum(zeros, 62 - MANTISSA)
    rest = (low >> (np.uint64(63 - MANTISSA) - zeros.astype(np.uint64))) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first].astype(np.int64)] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | rest).astype(np.uint16)
    return out


#: Where an empty register looks for a full one: places drawn at random, the same for all texts.
_PLACES = (mixed(np.arange(1, REGISTERS * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, 256)


def rows_of(percent: int) -> int:
    """Registers of a band, for links of percent or more: as many as keep the chance to miss a pair under MISS."""
    fit = [r for r in range(1, REGISTERS // BANDS + 1) if (1 - (percent / 100) ** r) ** BANDS <= MISS]
    return max(fit, default=1)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of so many registers; an empty register takes the value of the first full one among its places, so that a band of a small
    set draws its members one by one, as that of a large set does."""
    full = sketch != _EMPTY
    source = np.arange(REGISTERS)
    empty = np.flatnonzero(~full)
    for a, b in ((0, 16), (16, 256)):
        if len(empty):
            hit = full[_PLACES[empty, a:b]]
            nth = hit.argmax(1)
            got = hit[np.arange(len(empty)), nth]
            source[empty[got]] = _PLACES[empty[got], a + nth[got]]
            empty = empty[~got]
    if len(empty):
        at = np.flatnonzero(full)
        source[empty] = at[np.searchsorted(at, empty) % len(at)]
    values = mixed(sketch[source[: BANDS * rows]].astype(np.uint64)).reshape(BANDS, rows)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(rows):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + values[:, j]
    return mixed(acc).view(np.int64)


def by_chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that a register of two unrelated sets of these sizes is equal: the smallest hashes have densities x * exp(-x * u), x hashes a bucket, and fall in one cell, of
    width 2^-(zeros + 1 + MANTISSA); summed over the counts of leading zeros."""
    x, y = na[:, None] / REGISTERS, nb[:, None] / REGISTERS
    low = 0.5 ** np.arange(1, 40)[None, :]
    return (low * x * y / (x + y) * (np.exp(-(x + y) * low) - np.exp(-(x + y) * 2 * low))).sum(1) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (pairs, REGISTERS) of sets of na and nb hashes, corrected for registers that are equal by chance."""
    either = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & either).sum(1)
    chance = by_chance(na, nb)
    return (same / np.maximum(either.sum(1), 1) - chance) / (1 - chance)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", "text")


def sketches(docs: DataFrame, k: int, rows_: int) -> DataFrame:
    """For each row: doc_id, n_shingles, two sums of the set's hashes, the sketch and the band hashes (null if the set is empty)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                hashes, _, _, n = hashed_words(data, ends, True)
                rows = []
                for lo, hi in zip(np.concatenate(([0], n[:-1])).tolist(), n.tolist()):
                    found = shingles(hashes[lo:hi], k)
                    if len(found):
                        sketch = registers(found)
                        rows.append((len(found), int(np.add.reduce(found).view(np.int64)), int(np.add.reduce(mixed(found ^ np.uint64(77))).view(np.int64)), sketch.tobytes(), bands(sketch, rows_)))
                    else:
                        rows.append((0, 0, 0, None, None))
                sizes, s1, s2, regs, groups = zip(*rows, strict=True)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "n_shingles": pa.array(sizes, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "regs": pa.array(regs, pa.binary()), "bands": pa.array(groups, pa.list_(pa.int64()))})

    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, regs binary, bands array<long>")


def _estimated(pairs: DataFrame, regs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimate is not clearly below the threshold: within five standard deviations of it."""
    both = pairs.join(regs.selectExpr("doc_id as a", "regs as ra", "n_shingles as na"), "a").join(regs.selectExpr("doc_id as b", "regs as rb", "n_shingles as nb"), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                good = estimate(ra, rb, na, nb) >= least_estimate(least, np.minimum(na, nb))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(keep, pairs.select("a", "b").schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the wanted documents (doc_id)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in blocks(batch.column("text")):
                hashes, _, _, n = hashed_words(data, ends, True)
                sets = [shingles(hashes[lo:hi], k).tobytes() for lo, hi in zip(np.concatenate(([0], n[:-1])).tolist(), n.tolist())]
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "shingles": pa.array(sets, pa.binary())})

    return docs.join(wanted, "doc_id", "left_semi").mapInArrow(full, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles binary")


def _enough(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (na + nb - shared)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                good.append(bool(_enough((both[1:] == both[:-1]).sum(), len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.selectExpr("doc_id as a", "shingles as sa"), "a").join(sets.selectExpr("doc_id as b", "shingles as sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, pairs.select("a", "b").schema)


class Members:
    """Members of a block: ids, components, band hashes, sketches and sets."""

    def __init__(self, rows: pa.Table):
        self.ids, self.components = rows.column("rep").to_pylist(), np.array(rows.column("component").to_pylist())
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        self.sizes = np.array([len(x) for x in self.sets])


def block_links(some: Members, others: Members, percent: int, step: int = 256) -> Iterator[tuple]:
    """Links between some and others that connect components not yet connected, found in squares of step members."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a in range(0, len(some.ids), step):
        for b in range(0, len(others.ids), step):
            x, y = slice(a, a + step), slice(b, b + step)
            names_x = np.array([find(c) for c in some.components[x].tolist()])
            names_y = np.array([find(c) for c in others.components[y].tolist()])
            small = np.minimum(some.sizes[x][:, None], others.sizes[y][None, :])
            open_ = (names_x[:, None] != names_y[None, :]) & (100 * small >= percent * np.maximum(some.sizes[x][:, None], others.sizes[y][None, :]))
            met = np.zeros(open_.shape, bool)
            for j in range(BANDS):
                met |= some.bands[x, j][:, None] == others.bands[y, j][None, :]
            i, j = np.nonzero(open_ & met)
            if not len(i):
                continue
            steps = [(i[c : c + 4096], j[c : c + 4096]) for c in range(0, len(i), 4096)]
            near = np.concatenate([estimate(some.regs[x][p], others.regs[y][q], some.sizes[x][p], others.sizes[y][q]) for p, q in steps])
            keep = near >= least_estimate(percent / 100, small[i, j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            rows, cols = np.unique(i), np.unique(j)
            left, right = [some.sets[a + r] for r in rows], [others.sets[b + c] for c in cols]
            shared = intersections(left, right)[np.searchsorted(rows, i), np.searchsorted(cols, j)]
            good = _enough(shared, some.sizes[x][i], others.sizes[y][j], percent)
            for r, c in zip(i[good].tolist(), j[good].tolist(), strict=True):
                p, q = find(some.components[a + r].item()), find(others.components[b + c].item())
                if p != q:
                    root[p] = q
                    yield some.ids[a + r], others.ids[b + c]


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets: only hashes that occur on both sides count, as products of 0/1 matrices."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def matrix(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(sets), len(part)), np.float32)
        for r, s in enumerate(sets):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            m[r, at[part[at] == s]] = 1
        return m

    for c in range(0, len(common), 8192):
        part = common[c : c + 8192]
        out += matrix(left, part) @ matrix(right, part).T
    return out.astype(np.int64)


def least_estimate(least: float, small: np.ndarray) -> np.ndarray:
    """Estimates under this are clearly below the threshold: five standard deviations and the registers' own error."""
    return least - 5 * np.sqrt(least * (1 - least) / np.minimum(small, REGISTERS)) - 0.02


def _cluster_links(named: DataFrame, own: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within the clusters of named (band, rep, component), the groups that are not connected yet."""
    id_type = named.schema["rep"].dataType.simpleString()
    edges = named.groupBy("band").agg(F.min("rep").alias("v")).join(named, "band").where("rep <> v").select(F.col("rep").alias("u"), "v")
    clusters = components(edges).selectExpr("node as rep", "component as cluster").distinct()
    members = named.select("rep", "component").distinct().join(clusters, "rep").join(sets.selectExpr("doc_id as rep", "length(shingles) as bytes"), "rep")
    members = written(members)
    parts = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    main = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("bytes").alias("whole"), (F.sum("bytes") - F.max_by("bytes", F.struct("n", "component"))).alias("rest"))
    main = main.selectExpr("cluster", "main", f"whole div {BLOCK_BYTES} + 1 as wide", f"rest div {BLOCK_BYTES} + 1 as deep")
    placed = members.join(main, "cluster").withColumn("h", F.xxhash64("rep"))
    # rows of some (kind 0): the members outside the main component; rows of others (kind 1): all members
    some = placed.where("component <> main").select("cluster", "rep", "component", F.expr("pmod(h, deep)").alias("x"), F.explode(F.expr("sequence(0L, wide - 1)")).alias("y"), F.lit(0).alias("kind"))
    others = placed.select("cluster", "rep", "component", F.explode(F.expr("sequence(0L, deep - 1)")).alias("x"), F.expr("pmod(h, wide)").alias("y"), F.lit(1).alias("kind"))
    rows = some.unionByName(others).join(own.selectExpr("doc_id as rep", "bands", "regs"), "rep").join(sets.selectExpr("doc_id as rep", "shingles"), "rep")
    dealt = rows.withColumn("key", F.xxhash64("cluster", "x", "y")).repartition("key").sortWithinPartitions("key", "kind").select("key", "kind", "rep", "component", "bands", "regs", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != now:
                    yield from links(held)
                    now, held = keys[a], []
                held.append(batch.slice(a, b - a))
        yield from links(held)

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            table = pa.Table.from_batches(held)
            some = table.filter(pc.equal(table.column("kind"), 0))
            found = list(block_links(Members(some), Members(table.filter(pc.equal(table.column("kind"), 1))), percent)) if some.num_rows else []
            if found:
                yield pa.record_batch([pa.array(x, table.schema.field("rep").type) for x in zip(*found, strict=True)], names=["u", "v"])

    return dealt.mapInArrow(compare, f"u {id_type}, v {id_type}")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. Links: similarity of percent or more."""
    docs = docs.select("doc_id", "text")
    own = written(sketches(docs, k, rows_of(percent)))
    entries = own.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "s1", "s2")
    classes = entries.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    member = written(entries.join(classes, ["n_shingles", "s1", "s2"]).select("doc_id", "rep").distinct())
    # an id that repeats with other texts ties their classes together
    ties = member.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("u")).where("u <> v").select("u", "v")
    reps = own.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi").where("n_shingles > 0")
    regs = reps.select("doc_id", "n_shingles", "regs")
    rows = reps.select(F.explode("bands").alias("band"), F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"))
    shared = rows.groupBy("band").agg(F.count("*").alias("c"), F.min(F.struct("rep", "n")).alias("first")).where("c > 1")
    left = stored = written(rows.join(shared, "band").select("band", "rep", "n", "first"))
    texts = docs.where("doc_id is not null")
    links = written(ties)
    # quick rounds: each class tries one other, first the smallest of its groups, then members of their largest components
    of_rep = F.min(F.struct("first", "n"))
    pairs = left.where("rep > first.rep").groupBy("rep").agg(of_rep.alias("x")).selectExpr("x.first.rep as a", "x.first.n as na", "rep as b", "x.n as nb")
    left = left.select("band", "rep", "n")
    sets = written(_full_sets(texts, left.selectExpr("rep as doc_id").distinct(), k))
    for quick in range(1, QUICK + 2):
        near = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct()
        near = _confirmed(written(_estimated(near, regs, percent / 100)), sets, percent)
        before, links = links, written(links.unionByName(near.selectExpr("b as u", "a as v")))
        dropped(before)
        labels = components(links)
        # groups whose members are connected are done
        named = left.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "n", F.coalesce("component", "rep").alias("component"))
        open_ = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
        before, left = stored, written(named.join(open_, "band"))
        stored = left
        dropped(before)
        # next, each class tries a member of the largest component in one of its groups
        sizes = left.groupBy("band", "component").agg(F.count("*").alias("size"), F.min_by(F.struct("rep", "n"), F.xxhash64("rep", F.lit(quick))).alias("one"))
        lead = sizes.groupBy("band").agg(F.max_by(F.struct("component", "one"), F.struct("size", "component")).alias("lead"))
        tries = left.join(lead, "band").where("component <> lead.component").groupBy("rep", "n").agg(F.min_by("lead.one", F.xxhash64("band", F.lit(quick))).alias("one"))
        pairs = tries.selectExpr("least(one.rep, rep) as a", "if(one.rep < rep, one.n, n) as na", "greatest(one.rep, rep) as b", "if(one.rep < rep, n, one.n) as nb")
        left, named = left.select("band", "rep", "n"), left
    if not named.isEmpty():
        links = links.unionByName(_cluster_links(named, reps, sets, percent))
        labels = components(links)
    slim = written(own.select("doc_id", "n_shingles"))
    dropped(own, sets, stored)  # what is lazy from here on reads slim, member and labels
    out = slim.join(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) end s from w),
c as (select doc_id, s, len(s) n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by md5(array_to_string(s, chr(10))), len(s)) end rep from s),
x as (select doc_id, n, unnest(s) g from c where doc_id = rep),
p as (select a.doc_id x, b.doc_id y from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(x, y) as (select doc_id, doc_id from c where doc_id = rep union select r.x, p.y from r join p on r.y = p.x),
m as (select x, min(y) component_id from r group by x)
select doc_id, n::bigint n_shingles, component_id, doc_id = component_id kept from c join m on rep = x
"""
