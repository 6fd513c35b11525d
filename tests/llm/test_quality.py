"""The factorisation machine against all pairs and plain counting, and held-out documents."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skysweep.llm import quality
from skysweep.llm.common import blocks, hashed_words

TEXTS = ["The cat sat.\nThe cat sat.", "", "WOW!! BUY!! NOW!!", "a b a b a b a b", "one  two\tthree 4 5", "é ü\n\nx"]


def flat(texts):
    return next((data, ends) for _, _, data, ends in blocks(pa.array(texts)))


def test_scores_are_sums_over_all_pairs():
    r = np.random.default_rng(1)
    features = quality.Features({"n": True, "kind": False})
    machine = quality.Machine(features, 0.3, r.normal(size=features.size), r.normal(size=(features.size, quality.FACTORS)))
    data, ends = flat(TEXTS)
    rows, ids, x = features.of(data, ends, [pa.array([1, None, 3, 4, 5, 6]), pa.array(["a", None, "b c", "", "a", "a"])])
    got = machine.parts(rows, ids, x, len(TEXTS))[0]
    for i in range(len(TEXTS)):
        at = np.flatnonzero(rows == i)
        want = 0.3 + sum(machine.weights[ids[j]] * x[j] for j in at)
        want += sum(machine.factors[ids[j]] @ machine.factors[ids[k]] * x[j] * x[k] for j, k in itertools.combinations(at, 2))
        assert got[i] == pytest.approx(want)


def test_statistics_are_plain_counts():
    data, ends = flat(TEXTS)
    got = dict(zip(quality.STATISTICS, quality.statistics(data, ends, *hashed_words(data, ends, True)).T, strict=True))
    for i, text in enumerate(TEXTS):
        words, lines = text.lower().split(), [x.split() for x in text.lower().split("\n") if x.split()]
        triples = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        letters = [c for c in text.encode() if chr(c).isascii() and chr(c).isalpha() or c >= 128]
        assert got["words"][i] == pytest.approx(np.log1p(len(words)))
        assert got["lines"][i] == pytest.approx(np.log1p(text.count("\n") + 1))
        assert got["capitals"][i] == pytest.approx(sum(65 <= c <= 90 for c in letters) / max(1, len(letters)))
        assert got["distinct"][i] == pytest.approx(len(set(words)) / max(1, len(words)))
        assert got["commonest"][i] == pytest.approx(max(map(words.count, words), default=0) / max(1, len(words)))
        assert got["signed"][i] == pytest.approx(sum(len(w) > 2 and all(not c.isalnum() for c in w[-2:]) for w in words) / max(1, len(words)))
        assert got["repeated_lines"][i] == pytest.approx(1 - len(set(map(tuple, lines))) / len(lines) if lines else 0)
        assert got["repeated_sequences"][i] == pytest.approx(1 - len(set(triples)) / len(triples) if triples else 0)


def test_gradient_is_the_slope_of_the_loss(spark):
    features = quality.Features({})
    r = np.random.default_rng(2)
    machine = quality.Machine(features, 0.1, r.normal(size=features.size), r.normal(size=(features.size, quality.FACTORS)) * 0.3)
    docs = spark.createDataFrame([(i % 2, x) for i, x in enumerate(TEXTS)], "y int, text string")
    gradient, intercept = quality._gradient(quality._featured(docs, features, "y"), machine, {0: 1.0, 1: 2.0})
    data, ends = flat(TEXTS)
    triples = features.of(data, ends, [])
    y = np.arange(len(TEXTS)) % 2

    def loss():
        p = quality.curve(machine.parts(*triples, len(TEXTS))[0])
        return -(np.where(y > 0, 2 * np.log(p), np.log(1 - p))).sum()

    for at in np.unique(triples[1])[::7]:
        for place, array in ((gradient[at, 0], machine.weights[at : at + 1]), (gradient[at, 3], machine.factors[at, 2:3])):
            array += 1e-5
            up = loss()
            array -= 2e-5
            down = loss()
            array += 1e-5
            assert place == pytest.approx((up - down) / 2e-5, abs=1e-4)
    machine.base += 1e-5
    assert intercept == pytest.approx((loss() - (machine.base, setattr(machine, "base", machine.base - 2e-5), loss())[2]) / 2e-5, abs=1e-4)


def test_held_out_documents(spark):
    words, pick = ["sun", "moon", "tree", "house", "river", "stone", "green", "walks"], random.Random(4)

    def text(good):
        body = [" ".join(pick.choices(words, k=8)).capitalize() + "." for _ in range(pick.randint(2, 9))]
        return "\n".join(body) if good else pick.choice([" ".join(body).upper().replace(" ", "!! "), "\n".join([body[0]] * 9), " ".join(w + "###" for w in body[0].split())])

    rows = [(i, text(i % 3 > 0), i % 50 or None, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = quality.fit(docs, labels, ("n_chars",))
    got = quality.scored(docs, machine, ["doc_id"]).where("doc_id >= 400").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got) >= 195 and len(got) == 200


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (2, "x " * 200_000, None), (None, "word", "b")], "doc_id long, text string, kind string")
    none = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), ("kind",))
    assert [r.score for r in quality.scored(docs, none, ["doc_id"]).collect()] == [0.5] * 4
    some = quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int"), ("kind",))
    scores = quality.scored(docs, some, ["doc_id"]).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert scores[0].score == scores[1].score > 0.5 > scores[2].score and all(0 <= r.score <= 1 for r in scores)
    assert quality.scored(docs.limit(0), some, ["doc_id"]).count() == 0
