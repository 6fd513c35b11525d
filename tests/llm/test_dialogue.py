"""Repair of conversations against all edit scripts, and its edges."""

import hashlib
import itertools
import re

import pytest

from skysweep.llm import dialogue
from skysweep.llm.queries import damaged

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The cheapest of all edit scripts of a few rows (role, text), with at most two insertions before each row and at the end: cost, audit, repaired rows."""
    seen, faults = set(), []
    for role, text in rows:
        end = text.rstrip(dialogue.BLANKS)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    inserts = [(2 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in itertools.product(("user", "assistant"), repeat=n)]
    found = [(0, "", [])]
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [(3, "D", [])]
        if fault not in ("blank", "duplicate"):
            cut = fault == "truncated"
            own += [(cut, "K", [(role, text)]), (2 + cut, "R", [("user", text)]), (2 + cut, "R", [("assistant", text)])]
        found = [(a + b + c, x + y + z, p + q + r) for a, x, p in found for b, y, q in inserts for c, z, r in own]
        found = [f for f in found if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in f[2]))]
    found = [(a + b, x + y, p + q) for a, x, p in found for b, y, q in inserts]
    return min((a, x, p) for a, x, p in found if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in p)))


def cases():
    texts = itertools.cycle(["Yes.", "No.", " ", "and so", "Why?", "Yes."])
    roles = ["system", "user", "assistant", "tool"]
    out = []
    for i, combo in enumerate(itertools.product(roles, repeat=3)):
        out.append((i, [(r, next(texts)) for r in combo]))
    return out + [(100, [("user", "A.")]), (101, [("assistant", "x\n"), ("assistant", "x\n")]), (102, [("system", "S.")]), (103, [("user", "a."), ("user", "b."), ("", "c."), ("assistant", "d!")])]


def test_cheapest_edits(spark):
    given = cases()
    df = spark.createDataFrame([(c, t, r, x) for c, rows in given for t, (r, x) in enumerate(rows)], SCHEMA)
    edits = dialogue.repaired(df)
    got = {r.conv_id: r for r in dialogue.summarised(edits).collect()}
    rows = {}
    for r in edits.where("edit <> 'D'").orderBy("conv_id", "n", "part").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, given_rows in given:
        cost, audit, fixed = brute(given_rows)
        assert (got[conv].cost, got[conv].audit) == (cost, audit), (conv, given_rows)
        assert rows.get(conv, []) == fixed
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()


def test_nulls_repeats_gaps_and_clashing_columns(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, "system", "Be kind."), (None, 5, "assistant", None), (7, 3, None, "x."), (7, 3, None, "x."), (8, None, "user", "a.")]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA + ", fault string, n int")
    got = {r.conv_id: r for r in dialogue.summarised(dialogue.repaired(df)).collect()}
    assert (got[None].gaps, got[None].blank, got[None].audit) == (3, 1, "KKDI")
    assert (got[7].gaps, got[7].duplicate, got[7].illegal, got[7].audit) == (0, 1, 1, "DD")
    assert (got[8].gaps, got[8].audit) == (0, "KI")
    assert dialogue.summarised(dialogue.repaired(df.limit(0))).count() == 0


def test_a_conversation_over_many_batches(spark):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, t, ("user", "assistant")[t % 2], f"{t}. " + "long " * 50 + ".") for t in range(500)] + [(2, t, "user", f"{t}.") for t in range(300)]
        got = {r.conv_id: r for r in dialogue.summarised(dialogue.repaired(spark.createDataFrame(rows, SCHEMA))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert (got[1].cost, got[1].audit) == (0, "K" * 500)
    assert (got[2].cost, got[2].audit, got[2].illegal) == (300, "KR" * 150, 299)


def test_damage_is_by_conversation_and_turn(spark):
    df = spark.createDataFrame([(c, t, "assistant", "A. B!") for c in range(40) for t in range(5)], SCHEMA)
    hurt = damaged(df).groupBy("conv_id", "turn").count().collect()
    assert {r["count"] for r in hurt} == {1, 2} and len(hurt) < 200
    assert {(r.role, r.text) for r in damaged(df).collect()} == {("assistant", "A. B!"), ("assistant", ""), ("assistant", "A B"), ("user", "A. B!")}


@pytest.mark.parametrize("place, n", [(0, 2), (1, 2), (2, 1), (3, 0)])
def test_insertions_end_a_sequence(place, n):
    assert dialogue.ENDING[place] == (0 if place == 0 else n)
