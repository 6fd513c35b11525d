"""Operators against brute force and round trips on small tables with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysweep.llm import embdup, language, mixing, neardup, packing, pii, substrings, topk, toxicity, warc
from skysweep.llm.common import components


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    out = [None, "", "   ", "one", "one two", "One  TWO"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "en" if i % 2 else None, i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rep long")


def test_near_duplicates(docs, texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def without_repeats(texts):
    """By brute force: for each document the words covered by a window that starts in a smaller one too."""
    first, want = {}, {}
    for i, t in texts:
        w = (t or "").encode().split()
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest())
    return want


@pytest.fixture(scope="module")
def passages():
    """Passages in other surroundings, within one document too, and words that repeat."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 20, 40)] + [["a", "b"] * 20, ["x"] * 30]
    out = [None, "", "one two", " ".join(words[:12]), " ".join(words[:13]), " ".join(words[:13])]
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 15))] for _ in range(rng.randint(1, 8))]
        out.append("\t".join(x for part in parts for x in part))
    return list(enumerate(out))


@pytest.mark.parametrize("common", [2000, 1])
def test_substrings(spark, docs, texts, passages, monkeypatch, common):
    monkeypatch.setattr(substrings, "COMMON", common)  # at 1 every anchor is hot
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()} == without_repeats(texts)
    frame = spark.createDataFrame([(t, i, i, i) for i, t in passages], "text string, doc_id long, start long, other long")
    got = substrings.remove_repeats(frame, keep=["doc_id", "start", "other"]).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == without_repeats(passages) and all(r.start == r.other == r.doc_id for r in got)


def test_maximal_repeats(spark, passages):
    """Every repeat is one, is as long as it can be, and together they cover what is removed."""
    words = {i: (t or "").split() for i, t in passages}
    covered = defaultdict(set)
    for r in substrings.repeats(spark.createDataFrame(passages, "doc_id long, text string")).collect():
        assert r.other < r.doc_id and r.words >= 13
        assert words[r.doc_id][r.start : r.start + r.words] == words[r.other][r.other_start : r.other_start + r.words]
        covered[r.doc_id] |= set(range(r.start, r.start + r.words))
    assert {i: n for i, (_, n, _) in without_repeats(passages).items() if n} == {i: len(x) for i, x in covered.items()}


def test_substrings_of_rows_with_one_id(spark):
    """Rows with one id are one document; a null id is left alone; long texts are read whole."""
    passage, long = " ".join(f"p{i}" for i in range(20)), " ".join(f"l{i}" for i in range(50_000))
    rows = [(5, "a " + passage), (5, passage), (3, "b " + passage + " c"), (None, passage), (7, long + " " + passage), (7, None)]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [(0, 20, 0), (3, 22, 0), (5, 20, 20), (5, 21, 20), (7, 0, 0), (7, 50_020, 20)]


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    pieces, lines = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, length=64).collect():
        pieces[r.doc_id].append(r)
        lines[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sizes = Counter()
    for parts in lines.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes[at] += 1
    assert all(n & (n - 1) == 0 for n in sizes) and max(sizes) == 64


def test_mixing(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(8, 0.02 * t) for s, t in target.items())


def test_mixing_small_sources(spark):
    """Sources of a few words beside large ones: under half a block, about one block, and some blocks of the others' size."""
    sizes = {"large": [4000] * 500, "other": [4000] * 250, "tiny": [10] * 10, "small": [20] * 70, "some": [50] * 100}
    rows = [(s, n) for s, ns in sizes.items() for n in ns]
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, n int").selectExpr("doc_id", "source", "repeat('w ', n) as text")
    taken, target = Counter(), {}
    for r in mixing.mix(docs, keep=["doc_id", "source"], shard_words=10_000_000).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(target[s] > 0 and abs(taken[s] - t) <= max(8, 0.02 * t) for s, t in target.items()), (taken, target)


def test_pii(spark):
    rows = [(1, "call +1 (988) 555-2485 or 988-555-2485"), (2, "card 4041894974608795 not 4041894974608796, ip 42.144.35.254."), (3, "Mr John Smith and Mrs Smith, a.b@x.com"), (4, None), (5, ""), (6, "clean +1 4.0. text")]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    digits = lambda s: "".join(c for c in s if c.isdigit())
    one, other = got[1].split(" or ")
    assert digits(one)[-10:] == digits(other) != "9885552485" and one.startswith("call +1 (")
    assert "4041894974608795" not in got[2] and "4041894974608796" in got[2] and "42.144.35.254" not in got[2]
    assert "Smith" not in got[3] and got[3].split()[2] == got[3].split()[5].rstrip(",") and "a.b@x.com" not in got[3]
    assert (got[4], got[5], got[6]) == (None, "", "clean +1 4.0. text")


def test_pii_long_secrets(spark):
    rng = random.Random(5)
    signs = [rng.choice("abcdefghijkLMNOP") for _ in range(400)]
    late = "".join(signs[:300]) + "7" + "".join(signs[300:])  # the only digit comes after 300 signs
    long = "".join(rng.choice("abcdef0123456789") for _ in range(300))
    rows = [(1, f"token = {long} end"), (2, f'password="{late}", end'), (3, f"api_key: {long}"), (4, "token = " + "a" * 300 + " end")]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, value in ((1, long), (2, late), (3, long)):
        text, n = got[i]
        assert n == 1 and len(text) == len(dict(rows)[i])
        assert not any(value[j : j + 12] in text for j in range(len(value) - 11))
    assert got[1][0].endswith(" end") and got[2][0].startswith('password="') and got[2][0].endswith('", end')
    assert got[1][0].split()[2] == got[3][0].split()[1] and got[4] == (rows[3][1], 0)


@pytest.mark.parametrize(("small", "block"), [(32, 2048), (1, 2048), (1, 2)])
def test_embeddings(spark, monkeypatch, small, block):
    """Pairs of small buckets written out, or all buckets compared in blocks."""
    monkeypatch.setattr(embdup, "SMALL", small)
    monkeypatch.setattr(embdup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    vectors = np.concatenate((base, base[:15] + 0.15 * rng.standard_normal((15, 16)), base[10:30] + 0.3 * rng.standard_normal((20, 16)), base[:3]))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(vectors)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 0), (103, vectors[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & ~np.eye(len(unit), dtype=bool) & ((np.arange(len(unit))[:, None] - np.arange(len(unit))) % 2 == 0)
    got = {r.vec_id: r.n_links for r in embdup.near_duplicates(frame).collect()}
    assert got == {i: int(linked[i].sum()) for i in range(len(unit))} | {100: 0, 101: 0, 102: 0, 103: 0}
    whole = topk.integers(frame)
    table = {r.vec_id: np.array(r.v) for r in whole.collect()}
    best = defaultdict(list)
    for r in topk.top_k(whole, whole.where("vec_id % 10 = 0")).collect():
        best[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q, found in best.items():
        want = sorted(((-int(table[q] @ v), i) for i, v in table.items() if i != q))[:5]
        assert [(i, s) for _, i, s in sorted(found)] == [(i, -s) for s, i in want]


def test_embedding_tables_are_independent():
    """Pairs at the threshold meet in as many tables as independent tables would give: same mean, and the spread of a binomial."""
    bits, tables = embdup.table_sizes(100_000)
    rng, n = np.random.default_rng(4), 2000
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.standard_normal((2, n, 64)))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1)[:, None]
    shared = np.concatenate([(embdup.table_keys(a[i : i + 500], tables, bits) == embdup.table_keys(b[i : i + 500], tables, bits)).sum(1) for i in range(0, n, 500)])
    alike = (1 - np.arccos(0.93) / np.pi) ** bits
    assert abs(shared.mean() / (tables * alike) - 1) < 0.05
    assert abs(shared.var() / (tables * alike * (1 - alike)) - 1) < 0.15


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b c", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "u", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archive(warc.write_archive(pages, warc.archive_folder(pages)), with_payload=True).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[1].payload_bytes == 8 and got[2].record_type == "response"
    assert got[3].refers_to == 4 and bytes(got[5].payload).decode() == "é" * 5000 and got[3].payload_bytes == 0


def test_language_and_toxicity(spark):
    train = [("en", "the house and the garden are there"), ("de", "das haus und der garten sind dort")] * 20
    model = language.fit(spark.createDataFrame(train, "lang string, text string"))
    rows = [(1, "the garden and the house"), (2, "der garten und das haus"), (3, None), (4, "12 34 !"), (5, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and [got[i] for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert toxicity.folded(["You 1D10T, $cum"]).split() == ["you", "idiot", "scum"]
    lexicon = toxicity.Lexicon({" idiot ": 3.0}, ["idiot proof"])
    scored = {r.doc_id: r.hits for r in toxicity.scored(spark.createDataFrame([(1, "an 1d10t"), (2, "idiot proof thing"), (3, None)], "doc_id long, text string"), lexicon, ["doc_id"]).collect()}
    assert scored == {1: 3.0, 2: 0.0, 3: 0.0}


def test_rare_language_stays(spark):
    """A rare language beside a frequent one, under bounds on rows and words that the frequent one alone exceeds."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(400)]
    train = [("en", " ".join(rng.choice(words) for _ in range(8))) for _ in range(3000)] + [("ru", "дом и сад стоят там"), ("ru", "сад и дом"), ("el", "το σπίτι")] + [("en", "12 34")]
    model = language.fit(spark.createDataFrame(train, "lang string, text string"), max_rows=50)
    assert model.languages == ["el", "en", "ru"]
    rows = [(1, "там дом и сад"), (2, f"{words[0]} {words[1]}"), (3, "το σπίτι")]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "ru", 2: "en", 3: "el"}


def test_components_and_empty_tables(spark, docs):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    empty = docs.where(F.lit(False))
    for frame in (neardup.near_duplicates(empty), substrings.remove_repeats(empty), packing.pack(empty), mixing.mix(empty), pii.replace_entities(empty, "k")):
        assert frame.count() == 0
