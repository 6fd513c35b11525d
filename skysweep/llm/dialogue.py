"""Repair of conversations: the cheapest edits that give a legal sequence of roles.

A conversation is legal if its roles are, by their first letters, `(s?(ua)+)?`: an optional system turn, then user and assistant in turn. Edits of its rows, in the
order of turns: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and duplicate rows) and Insert an empty user or assistant turn
anywhere (2); a truncated row that stays adds 1. Of equally cheap edits those count whose initials come first in ASCII order.

Rows are dealt by conversation and sorted by turn once. A first pass carries the cost of the best edits that end in each of the four places of a legal
sequence (nothing yet, after system, after user, after assistant) across Arrow batches, and gives each row four back pointers of six bits. Rows and pointers are
then sorted the other way round, by Spark's own sort, which spills; a second pass walks the pointers from the last row to the first. No pass holds more than
a batch and a few numbers, so a conversation of any length takes the memory of a short one; its rows stay in one task, as the order of turns asks for.

Faults of a row, the first that holds: blank (nothing but `[\\x20\\x09-\\x0D]`), duplicate (role and text seen earlier in the conversation), truncated (the last other character is not
one of `.!?`). Null roles and texts count as one blank; a row with an empty role can't be kept as it is; rows with a null conv_id are one conversation; null turns come first; rows of one turn follow by role and text.
An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a legal sequence may have next: for each place (nothing yet, after system, user, assistant) the first letters that may follow, and the places they lead to.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The turn that an insertion or a change of role gives at each place.
WANTED = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Insertions in a row: more come back to a place that fewer reach.
MOST_INSERTS = 2
#: Insertions that end a sequence at each place.
ENDING = (0, 2, 1, 0)
LETTERS = "DKR"
BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 30


def _inserted(place: int, n: int) -> tuple[int, list[str]]:
    """The place after n insertions, and their roles."""
    roles = []
    for _ in range(n):
        roles.append(WANTED[place])
        place = FOLLOWS[place][WANTED[place][0]]
    return place, roles


@lru_cache(maxsize=None)
def _moves(initial: str, fault: str) -> list[tuple[int, int, int, str, int]]:
    """What may be done with a row: (from, to, cost, initials of the edits, pointer)."""
    out = []
    for start in range(4):
        for n in range(MOST_INSERTS + 1):
            place = _inserted(start, n)[0]
            ways = [("D", place, DELETE)]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED * (fault == "truncated")
                ways.append(("R", FOLLOWS[place][WANTED[place][0]], REROLE + extra))
                if initial in FOLLOWS[place]:
                    ways.append(("K", FOLLOWS[place][initial], extra))
            out += [(start, to, cost + INSERT * n, "I" * n + letter, start | n << 2 | LETTERS.index(letter) << 4) for letter, to, cost in ways]
    return out


@lru_cache(maxsize=1 << 16)
def _advance(costs: tuple[int, ...], ranks: tuple[int, ...], initial: str, fault: str) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    """After one more row: costs and ranks (the order of the edits' initials) by place, the row's pointers, and what the least cost has grown by.

    After a row, no place's initials begin another's: comparing the ranks before and then the row's own initials compares the whole strings."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for start, to, cost, name, pointer in _moves(initial, fault):
        if costs[start] < _FAR:
            way = (costs[start] + cost, ranks[start], name, pointer)
            best[to] = min(best.get(to, way), way)
    least = min(way[0] for way in best.values())
    order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    pointers = sum(way[3] << 6 * to for to, way in best.items())
    return tuple(best[to][0] - least if to in best else _FAR for to in range(4)), tuple(order.get(to, 0) for to in range(4)), pointers, least


@lru_cache(maxsize=1 << 16)
def _ended(costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[int, int]:
    """The cost of ending here, over the least cost, and the place that it ends from."""
    cost, _, place = min((costs[p] + INSERT * ENDING[p], ranks[p], p) for p in range(4))
    return cost, place


_START = ((0, _FAR, _FAR, _FAR), (0, 0, 0, 0))


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key: object = _forward  # no conversation
    costs = ranks = before = None
    total = n = 0
    for batch in batches:
        out = []
        for own, initial, fault in zip(batch["conv_id"], batch["role"].str[:1], batch["fault"], strict=True):
            if own != key:
                key, (costs, ranks), total, n, before = own, _START, 0, 0, None
            costs, ranks, pointers, grown = _advance(costs, ranks, initial, fault)
            total += grown
            rest, place = _ended(costs, ranks)
            out.append((n, pointers | place << 24, total + rest, before is not None and before + initial not in ("su", "ua", "au")))
            before, n = initial, n + 1
        yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["n", "pointers", "cost", "illegal"])], axis=1)


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key: object = _backward
    place = 0
    for batch in batches:
        out = []
        for own, pointers in zip(batch["conv_id"], batch["pointers"], strict=True):
            after: list[str] = []
            if own != key:  # the last row of a conversation
                key, place = own, pointers >> 24
                after = _inserted(place, ENDING[place])[1]
            pointer = pointers >> 6 * place & 63
            start, inserts, letter = pointer & 3, pointer >> 2 & 3, LETTERS[pointer >> 4]
            at, roles = _inserted(start, inserts)
            out.append((letter, WANTED[at] if letter == "R" else None, ",".join(roles), ",".join(after)))
            place = start
        edits = pd.DataFrame(out, columns=["edit", "new_role", "before", "after"])
        yield pd.concat([batch.drop(columns="pointers").reset_index(drop=True), edits], axis=1)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with fault: blank, duplicate, truncated or an empty string. Dealt by conversation."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))  # the dealing by conversation serves it
    rows = rows.withColumns({"seen": seen, "end": F.rtrim("text", F.lit(BLANKS))})
    fault = "case when end = '' then 'blank' when seen > 1 then 'duplicate' when substring(end, -1, 1) not in ('.', '!', '?') then 'truncated' else '' end"
    return rows.withColumn("fault", F.expr(fault)).drop("end")


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of rows (conv_id, turn, role, text), conversation by conversation and in order: conv_id, n (the row's place in its conversation, or that of the row an insertion
    stands by), part (order of the edits at one row), edit (K, R, D or I), turn (null for insertions), role and text (those of the repaired conversation; a
    deleted row's own), and of the row itself (null for insertions) fault, illegal (its role may not follow the role before) and cost (of the cheapest edits if it were the last row).

    Without the rows whose edit is D this is the repaired conversation."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    checked = faults(rows).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen").selectExpr("cast(conv_id as string) as conv_id", "cast(turn as string) as turn", "role", "text", "fault")
    own = "conv_id string, turn string, role string, text string, fault string, n long, cost long, illegal boolean"
    ahead = checked.mapInPandas(_forward, own.replace("cost long", "pointers long, cost long"))
    back = ahead.sortWithinPartitions("conv_id", F.desc("n")).mapInPandas(_backward, own + ", edit string, new_role string, before string, after string")
    there = "named_struct('edit', edit, 'turn', turn, 'role', coalesce(new_role, role), 'text', text, 'fault', fault, 'illegal', illegal, 'cost', cost)"
    new = "transform(filter(split({}, ','), r -> r <> ''), r -> named_struct('edit', 'I', 'turn', cast(null as string), 'role', r, 'text', '', 'fault', cast(null as string), 'illegal', cast(null as boolean), 'cost', cast(null as bigint)))"
    edits = back.sortWithinPartitions("conv_id", "n").selectExpr("conv_id", "n", f"posexplode(concat({new.format('before')}, array({there}), {new.format('after')})) as (part, e)")
    return edits.selectExpr(f"cast(conv_id as {kinds['conv_id']}) as conv_id", "n", "part", "e.edit", f"cast(e.turn as {kinds['turn']}) as turn", "e.role", "e.text", "e.fault", "e.illegal", "e.cost")


SUMMARY = "conv_id string, first_turn string, last_turn string, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summarised(edits: DataFrame) -> DataFrame:
    """One row a conversation from repaired(): conv_id, gaps (turns missing between the first and the last), counts of rows by fault, illegal neighbours, cost, audit (the edits' initials)
    and the SHA-256 of the repaired `role:text` lines. The edits are read in the order that repaired() gives them; only a running digest and counters are held."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = passed
        now: dict = {}

        def row() -> tuple:
            return (key, now["first"], now["last"], now["turns"], now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["digest"].hexdigest())

        for batch in batches:
            done = []
            for own, edit, turn, role, text, fault, illegal, cost in batch.itertuples(index=False, name=None):
                if own != key:
                    if now:
                        done.append(row())
                    key = own
                    now = {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "digest": hashlib.sha256(), "lines": 0}
                now["audit"].append(edit)
                if edit != "I":
                    now["cost"] = int(cost)
                    now["illegal"] += bool(illegal)
                    if fault:
                        now[fault] += 1
                    if turn is not None and turn != now["last"]:
                        now["first"], now["last"], now["turns"] = now["first"] or turn, turn, now["turns"] + 1
                if edit != "D":
                    now["digest"].update((("\n" if now["lines"] else "") + role + ":" + text).encode())
                    now["lines"] += 1
            yield pd.DataFrame(done, columns=[x.split()[0] for x in SUMMARY.split(", ")])
        if now:
            yield pd.DataFrame([row()], columns=[x.split()[0] for x in SUMMARY.split(", ")])

    read = edits.select(F.col("conv_id").cast("string").alias("conv_id"), "edit", F.col("turn").cast("string").alias("turn"), "role", "text", "fault", "illegal", "cost")
    gaps = "coalesce(try_cast(last_turn as bigint) - try_cast(first_turn as bigint) + 1 - turns, 0L) as gaps"
    return read.mapInPandas(passed, SUMMARY).selectExpr(f"cast(conv_id as {kind}) as conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


ORACLE = """
with recursive given as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations),
hashed as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 h from given),
hurt as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(range(case when h = 3 then 2 else 1 end)) where h <> 0),
dup as (select *, row_number() over (partition by conv_id, role, text order by turn nulls first) seen, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) fin from hurt),
rowed as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text, seen) n, substr(role, 1, 1) c,
  case when fin = '' then 'blank' when seen > 1 then 'duplicate' when right(fin, 1) not in ('.', '!', '?') then 'truncated' else '' end f from dup),
counted as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 'blank') blank, count(*) filter (f = 'duplicate') duplicate, count(*) filter (f = 'truncated') truncated, count(*) m from rowed group by conv_id),
bad as (select conv_id, count(*) illegal from (select conv_id, n, lag(c) over (partition by conv_id order by n) || c pair from rowed) where n > 1 and pair not in ('su', 'ua', 'au') group by conv_id),
-- places: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; inserting leads from p to ins(p)
place as (select * from (values (0, 0, 2, 'user'), (1, 1, 2, 'user'), (2, 2, 3, 'assistant'), (3, 3, 2, 'user')) t(p, q, nxt, want)),
jump as (select p, p q, 0 c, '' a, '' o from place union all select p, nxt, 2, 'I', want || ':' || chr(10) from place
  union all select x.p, y.nxt, 4, 'II', x.want || ':' || chr(10) || y.want || ':' || chr(10) from place x join place y on y.p = x.nxt),
walk as (select conv_id, 0::bigint n, 0 p, 0 cost, '' audit, '' made from counted
  union all select conv_id, n, p, cost, audit, made from (
    select w.conv_id, w.n + 1 n, e.q p, w.cost + j.c + e.c cost, w.audit || j.a || e.a audit, w.made || j.o || e.o made from walk w join rowed r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1
    join jump j on j.p = w.p join place x on x.p = j.q,
    lateral (select x.p q, 3 c, 'D' a, '' o union all select x.nxt, 2 + (r.f = 'truncated')::int, 'R', x.want || ':' || r.text || chr(10) where r.f not in ('blank', 'duplicate')
      union all select case r.c when 's' then 1 when 'u' then 2 else 3 end, (r.f = 'truncated')::int, 'K', r.role || ':' || r.text || chr(10)
      where r.f not in ('blank', 'duplicate') and ((r.c = 's' and x.p = 0) or (r.c = 'u' and x.p <> 2) or (r.c = 'a' and x.p = 2))) e)
    qualify row_number() over (partition by conv_id, p order by cost, audit) = 1),
finished as (select w.conv_id, w.cost + j.c cost, w.audit || j.a audit, w.made || j.o made from walk w join counted k on k.conv_id is not distinct from w.conv_id and k.m = w.n
  join jump j on j.p = w.p and j.q in (0, 3) qualify row_number() over (partition by w.conv_id order by w.cost + j.c, w.audit || j.a) = 1)
select g.conv_id, coalesce(k.gaps, 0)::bigint gaps, coalesce(k.blank, 0) blank, coalesce(k.duplicate, 0) duplicate, coalesce(k.truncated, 0) truncated, coalesce(b.illegal, 0) illegal,
  coalesce(f.cost, 0)::bigint as cost, coalesce(f.audit, '') audit, sha256(coalesce(left(f.made, greatest(0, len(f.made) - 1)), '')) repaired_sha256
from (select distinct conv_id from conversations) g left join counted k on k.conv_id is not distinct from g.conv_id left join bad b on b.conv_id is not distinct from g.conv_id
left join finished f on f.conv_id is not distinct from g.conv_id
"""
