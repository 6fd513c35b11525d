"""Mixing sources to target weights, by Sainte-Laguë apportionment of equal-token blocks; DataFrame operations only.

1. Sources in code-point order (null last) get the weights in turn; a source's target is its share of all words, and stops at
   max_repeat times its size, the excess reshared by weight.
2. All words make equal blocks. They are apportioned to the sources by their targets, and a source's to its shards by their words, each time by the Sainte-Laguë rule: a block goes to the highest
   quotient weight / (2 * blocks so far + 1). The quotas are integers. A source of fewer than FEW blocks a shard, or with a target of fewer than FEW, cuts finer blocks of
   its own and takes as many as its target holds; the other sources share the rest.
3. A shard holds the documents of one source with one hash of the id. In seeded order they form a line of words, cut into equal
   blocks. A shard with quota q and b blocks takes each block q div b times, and q mod b blocks, picked by a seeded hash, once
   more. A document's words taken are those of its part in the taken blocks, at most max_repeat times its size.

Sizes are words; a null text has 0 words. A row without an id is placed by its text. Documents without words take nothing; an empty table gives an empty one. Rows with
one id and equal sizes are interchangeable; the kept columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysweep.llm.common import written

#: Signs (hexadecimal) of a document's mark that name its stretch of a shard's line.
STRETCH = 2
#: Blocks a shard, or a target, under which a source has blocks of its own.
FEW = 100
WORD = r"[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text; 0 if it is null."""
    return F.expr(f"coalesce(cast(regexp_count({text}, '{WORD}') as bigint), 0L)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """From (source, source_size, ...), one row a source, the same with target.

    Sources are looked at by cap over weight, lowest first: those whose cap lies under the level that would share the rest by weight are full."""
    nth = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.expr("cast(cap as double) / weight"), "i")
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("i", F.row_number().over(nth))
        .withColumn("weight", F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), F.expr(f"cast((i - 1) % {len(weights)} + 1 as int)")))
        .withColumn("cap", F.expr(f"source_size * {max_repeat}"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.expr("cast(total - caps as double) / cast(weights as double)"))
        .withColumn("end", F.max("level").over(everything))  # rises while sources are full, then falls
        .withColumn("target", F.expr("least(cast(cap as double), end * weight)"))
    )
    return rows.select(*sizes.columns, "target")


def apportioned(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """rows with quota: the seats of each group, dealt to its rows by the highest quotients weight / (2 * quota + 1), ties to
    the lower key. Only seats near a row's share can be in doubt, so only their quotients are ranked."""
    whole = Window.partitionBy(*group)
    shares = (
        rows.withColumn("_n", F.count("*").over(whole))
        .withColumn("_w", F.sum(F.col(weight).cast("double")).over(whole))
        .withColumn("_lo", F.expr(f"greatest(0L, cast(floor(({seats} - _n / 2.0D) * cast({weight} as double) / _w) as bigint) - 2)"))
        .withColumn("_hi", F.expr(f"greatest(0L, cast(floor(({seats} + _n / 2.0D) * cast({weight} as double) / _w) as bigint)) + 3"))
        .withColumn("_open", F.expr(seats) - F.sum("_lo").over(whole))
    )
    ranked = shares.withColumn("_seat", F.explode(F.expr("sequence(_lo, _hi)"))).withColumn("_rank", F.row_number().over(whole.orderBy(F.expr(f"cast({weight} as double) / (2 * _seat + 1)").desc(), *key)))
    return ranked.groupBy(*rows.columns).agg((F.max("_lo") + F.count(F.expr("case when _rank <= _open then 1 end"))).alias("quota"))


def mix(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 42, shard_words: int = 8_000_000, shard_blocks: int = 1000) -> DataFrame:
    """The columns keep (doc_id, unless given) of docs (doc_id, text, source, ...) with size, source_size, target and taken.

    Shards hold about shard_words words; a block is such that an average shard has shard_blocks of them. Kept columns must not
    begin with "_", nor have the name of a result."""
    keep = keep or ["doc_id"]
    mark = F.expr(f"md5(cast(concat('{seed}:', coalesce(cast(doc_id as string), md5(cast(coalesce(text, '') as binary)))) as binary))")
    rows = docs.select(*keep, F.col("doc_id").alias("_id"), F.col("source").alias("_source"), mark.alias("_mark"), word_count().alias("_size"))
    rows = rows if "text" in keep else written(rows)  # texts are rather counted twice than stored twice
    totals = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    sources = (
        source_targets(totals, weights, max_repeat)
        .withColumn("shards", F.expr(f"greatest(source_size div {shard_words}, n div {shard_words // 20}) + 1"))
        .withColumn("block", F.expr(f"greatest(1L, sum(source_size) over () div (sum(shards) over () * {shard_blocks}L))"))
        .withColumn("few", F.expr(f"target > 0 and block > 1 and (source_size < block * shards * {FEW} or target < block * {FEW})"))
        .withColumn("few_words", F.expr("cast(round(coalesce(sum(case when few then target end) over (), 0D)) as bigint)"))
        .withColumn("seats", F.expr("(sum(source_size) over () - few_words) div block"))
        .withColumn("block", F.expr(f"case when few then greatest(1L, least(source_size div (shards * {shard_blocks}L), cast(target as bigint) div {shard_blocks}L)) else block end"))
    )
    own = sources.where("few or target = 0").withColumn("source_quota", F.expr("cast(round(target / block) as bigint)"))
    sources = apportioned(sources.where("target > 0 and not few"), ["block", "seats"], ["source"], "target", "seats").withColumnRenamed("quota", "source_quota").unionByName(own)
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("_sid")  # a key that is never null
    sources = written(sources.select(number, F.col("source").alias("_s"), "source_size", "target", "shards", "block", "source_quota"))
    rows = rows.join(sources, F.expr("_source <=> _s")).withColumn("_shard", F.expr("pmod(cast(conv(substr(_mark, 1, 8), 16, 10) as bigint), shards)"))

    # a shard's line is in the order of the marks; its stretches, by the first signs of the mark, are placed by their sums, so that no task has a whole shard
    rows = rows.withColumn("_part", F.expr(f"substr(_mark, 1, {STRETCH})"))
    parts = written(rows.groupBy("_sid", "_s", "_shard", "block", "source_quota", "_part").agg(F.sum("_size").alias("of_part")))
    shards = parts.groupBy("_sid", "_s", "_shard", "block", "source_quota").agg(F.sum("of_part").alias("words")).where("words > 0")
    quotas = apportioned(shards, ["_sid", "source_quota"], ["_shard"], "words", "source_quota")
    quotas = quotas.withColumn("blocks", F.expr("greatest(1L, cast(round(cast(words as double) / block) as bigint))")).withColumn("quota", F.expr(f"least(quota, {max_repeat} * blocks)"))
    once_more = (
        quotas.withColumn("_block", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumn("_rank", F.expr(f"row_number() over (partition by _sid, _shard order by md5(cast(concat('{seed}:', coalesce(_s, ''), ':', cast(_shard as string), ':', cast(_block as string)) as binary)))"))
        .groupBy("_sid", "_shard", "words", "blocks", "quota")
        .agg(F.expr("collect_list(case when _rank <= quota % blocks then _block end)").alias("more"))
    )
    # of the blocks taken once more a stretch needs those that it touches; block j is [j * words div blocks, (j + 1) * words div blocks)
    places = parts.select("_sid", "_shard", "_part", "of_part", F.expr("sum(of_part) over (partition by _sid, _shard order by _part) - of_part").alias("base")).join(once_more, ["_sid", "_shard"], "left")
    places = places.withColumn("more", F.expr("filter(more, j -> j >= base * blocks div words and j <= (base + of_part) * blocks div words + 1)"))
    places = places.select(F.col("_sid").alias("_qsid"), F.col("_shard").alias("_qshard"), F.col("_part").alias("_qpart"), "base", "words", "blocks", "quota", "more")
    line = Window.partitionBy("_sid", "_shard", "_part").orderBy("_mark", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(places, F.expr("_sid = _qsid and _shard = _qshard and _part = _qpart")).withColumn("_end", F.col("base") + F.sum("_size").over(line))
    first, last = "((_end - _size) * blocks div words)", "(_end * blocks div words + 1)"
    overlap = "greatest(0L, least(_end, (j + 1) * words div blocks) - greatest(_end - _size, j * words div blocks))"
    extra = f"aggregate(filter(sequence({first}, {last}), j -> array_contains(more, j)), 0L, (a, j) -> a + {overlap})"
    taken = F.expr(f"case when _size > 0 and words > 0 then _size * (quota div blocks) + {extra} else 0L end")
    return placed.select(*keep, F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, md5('42:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) mark,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size
  from documents),
t as (select source, sum(size)::bigint source_size, count(*)::bigint n from d group by source),
a as (select *, row_number() over (order by source is null, source) i from t),
b as (select *, [5, 2, 1][((i - 1) % 3 + 1)::int]::bigint weight, source_size * 3 cap, (sum(source_size) over ())::bigint total from a),
c as (select *, coalesce(sum(cap) over (order by cap::double / weight, i rows between unbounded preceding and 1 preceding), 0)::bigint caps,
        (sum(weight) over (order by cap::double / weight, i rows between current row and unbounded following))::bigint weights from b),
e as (select *, (total - caps)::double / weights::double lev from c),
f as (select *, max(lev) over () en from e),
g as (select source, source_size, n, least(cap::double, en * weight) target,
        greatest(source_size // 8000000, n // 400000) + 1 shards, total from f),
h as (select *, greatest(1, total // ((sum(shards) over ())::bigint * 1000))::bigint block from g),
i as (select *, total // block seats from h),
s1 as (select *, count(*) over () n_, sum(target) over () w_ from i where target > 0),
s2 as (select *, greatest(0, floor((seats - n_ / 2.0::double) * target / w_)::bigint - 2) lo,
         greatest(0, floor((seats + n_ / 2.0::double) * target / w_)::bigint) + 3 hi from s1),
s3 as (select *, seats - (sum(lo) over ())::bigint op, unnest(range(lo, hi + 1)) seat from s2),
s4 as (select *, row_number() over (order by target / (2 * seat + 1) desc, source nulls first) rk from s3),
so as (select source, source_size, target, shards, block, max(lo) + count(case when rk <= op then 1 end) sq from s4 group by all
       union all select source, source_size, target, shards, block, 0 from i where target = 0),
r as (select d.*, source_size, target, shards, block, sq, ('0x' || substr(mark, 1, 8))::bigint % shards shard
      from d join so on d.source is not distinct from so.source),
q1 as (select source, shard, block, sq, sum(size)::bigint words from r group by all having sum(size) > 0),
q2 as (select *, count(*) over (partition by source) n_, sum(words::double) over (partition by source) w_ from q1),
q3 as (select *, greatest(0, floor((sq - n_ / 2.0::double) * words::double / w_)::bigint - 2) lo,
         greatest(0, floor((sq + n_ / 2.0::double) * words::double / w_)::bigint) + 3 hi from q2),
q4 as (select *, sq - (sum(lo) over (partition by source))::bigint op, unnest(range(lo, hi + 1)) seat from q3),
q5 as (select *, row_number() over (partition by source order by words::double / (2 * seat + 1) desc, shard) rk from q4),
q6 as (select source, shard, words, block, max(lo) + count(case when rk <= op then 1 end) quota from q5 group by all),
q7 as (select source, shard, words, greatest(1, round(words::double / block)::bigint) blocks, quota from q6),
q as (select source, shard, words, blocks, least(quota, 3 * blocks) quota from q7),
k1 as (select *, unnest(range(0, blocks)) j from q),
k2 as (select *, row_number() over (partition by source, shard order by md5('42:' || coalesce(source, '') || ':' || shard || ':' || j)) rk from k1),
k as (select source, shard, j, words, blocks from k2 where rk <= quota % blocks),
p as (select *, (sum(size) over (partition by source, shard order by mark, doc_id, size rows unbounded preceding))::bigint en,
        row_number() over () id from r),
x as (select id, sum(greatest(0, least(en, (j + 1) * words // blocks) - greatest(en - size, j * words // blocks)))::bigint more
      from p join k on p.source is not distinct from k.source and p.shard = k.shard
        and j * words // blocks < en and (j + 1) * words // blocks > en - size group by id)
select doc_id, size, source_size, target,
       case when size > 0 then size * (quota // blocks) + coalesce(more, 0) else 0 end::bigint taken
from p left join x using (id) left join q on p.source is not distinct from q.source and p.shard = q.shard
"""
