"""Hard negatives against brute force: many small blocks, hot copies, ties, nulls and odd components."""

import numpy as np
import pytest

from skysweep.llm import negatives, topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=5):
    valid = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = ([int(np.floor(256 * c)) for c in v], label)
        valid[i] = max(valid.get(i, x), x)
    width = max((len(v) for v, _ in valid.values()), default=0)
    ids = sorted(valid)
    table = np.array([valid[i][0] + [0] * (width - len(valid[i][0])) for i in ids], np.int64).reshape(len(ids), width)
    labels = np.array([valid[i][1] for i in ids])
    out = []
    for a, i in enumerate(ids):
        if i % every:
            continue
        scores = table @ table[a]
        order = [b for b in np.lexsort((ids, -scores)) if b != a]
        for p in [b for b in order if labels[b] == labels[a]][:5]:
            good = [b for b in order if labels[b] != labels[a] and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]][:3]
            out += [(i, ids[p], r + 1, ids[b], int(scores[p]), int(scores[b])) for r, b in enumerate(good)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture(scope="module")
def given():
    random = np.random.default_rng(3)
    centres = random.normal(size=(6, 9))
    rows = [(i, (centres[i % 6] * 0.7 + random.normal(size=9) * 0.4).tolist(), int(random.integers(4))) for i in range(300)]
    rows += [(i, centres[0].tolist(), int(i % 2)) for i in range(300, 420)]  # a third of all rows in one cell
    rows += [(None, [1.0] * 9, 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")] * 9, 1), (503, [1.0] * 9, None), (504, [float("inf")] * 9, 2), (505, [1.0, 2.0], 1), (10, [3.0] * 9, 2), (510, [0.0] * 9, 3), (515, [], 0)]
    return rows


@pytest.mark.parametrize("blocks", [(2048, 65_536), (16, 24)])
def test_equals_brute_force(spark, given, blocks, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    df = spark.createDataFrame(given, SCHEMA)
    rows = negatives.integers(df)
    want = brute(given)
    assert len(want) > 100
    assert got(negatives.hard_negatives(rows, "vec_id % 5 = 0", least_block=blocks[0], most_block=blocks[1])) == want


def test_blocks_far_away_are_not_visited(spark):
    random = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[i % 8] * 10 + random.normal(size=8) * 0.01).tolist(), i % 3) for i in range(400)]
    index = negatives.Index(negatives.integers(spark.createDataFrame(rows, SCHEMA)), 50, 50)
    asked = index.rows.where("vec_id % 20 = 0").selectExpr("vec_id", "label", "v", "block", "cast(array() as array<long>) as scores", "array(60000L * 90) as floors")
    assert index.blocks >= 8 and 0 < index.routed(asked, False).count() + asked.count() < asked.count() * index.blocks / 2
    assert got(negatives.hard_negatives(negatives.integers(spark.createDataFrame(rows, SCHEMA)), "vec_id % 5 = 0", least_block=50, most_block=50)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", v int, rank int")
    assert negatives.hard_negatives(negatives.integers(df), "vec_id % 5 = 0").count() == 0
    rows = [(5, [0.5, 0.5], 0, 1, 1), (6, [0.5, 0.4], 0, 1, 1), (7, [0.4, 0.35], 1, 1, 1)]
    assert got(negatives.hard_negatives(negatives.integers(spark.createDataFrame(rows, SCHEMA + ", v int, rank int")), "vec_id % 5 = 0")) == brute([r[:3] for r in rows])


def test_scores_beyond_64_bits_are_refused(spark):
    rows = negatives.integers(spark.createDataFrame([(5, [1e8] * 64, 0), (6, [1e8] * 64, 1)], SCHEMA))
    with pytest.raises(ValueError, match="64 bits"):
        negatives.hard_negatives(rows, "vec_id % 5 = 0")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(rows.select("vec_id", "v"), rows.select("vec_id", "v"))
