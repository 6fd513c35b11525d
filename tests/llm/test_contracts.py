"""Brute-force versions of what SQL can't express, and the edges that every operator and stage must take: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import itertools
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skysweep.llm import embdup, language, mixing, neardup, packing, pii, queries, substrings, topk, toxicity, warc
from skysweep.llm.common import aside

# --- language ID ---


def segmentations(word, vocabulary):
    """All ways to cut a word into pieces; a letter that is no piece may stand alone."""
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in vocabulary or k == 1:
            for rest in segmentations(word[k:], vocabulary):
                yield (word[:k], *rest)


def signs_of(words):
    sizes = np.array([len(w) for w in words])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes


@pytest.fixture()
def model():
    vocabulary = ["▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc", "bcab"]
    out = language.Pieces(vocabulary, ["x", "y"])
    chance = np.random.default_rng(1).random((len(out.hashes) + 1, 2))
    chance[-1] = 0
    out.chance = chance / chance.sum(0)
    place = {int(h): i for i, h in enumerate(out.hashes)}
    return out, {v: out.chance[place[language._piece_hash(v)]] for v in vocabulary}, {v: place[language._piece_hash(v)] for v in vocabulary}


WORDS = ["a", "abc", "abcab", "bcabcabc", "azb", "ccc", "zz", "aaaaab"]


def test_likelihood_is_the_sum_over_all_segmentations(model):
    pieces, chance, _ = model
    signs, starts, sizes = signs_of(WORDS)
    got = pieces.likelihoods(language.padded(signs, starts, sizes), sizes + 1)
    for word, ll in zip(WORDS, got, strict=True):
        want = sum(np.prod([chance.get(p, np.full(2, language.UNKNOWN)) for p in cut], axis=0) for cut in segmentations("▁" + word, chance))
        assert np.allclose(np.exp(ll), want, rtol=1e-9)


def test_expected_counts_are_those_of_all_segmentations(model):
    pieces, chance, place = model
    signs, starts, sizes = signs_of(WORDS)
    counts = np.arange(2.0 * len(WORDS)).reshape(-1, 2)
    want = np.zeros_like(pieces.chance)
    for word, n in zip(WORDS, counts, strict=True):
        cuts = list(segmentations("▁" + word, chance))
        weights = [np.prod([chance.get(p, np.full(2, language.UNKNOWN)) for p in cut], axis=0) for cut in cuts]
        for cut, w in zip(cuts, weights, strict=True):
            for p in cut:
                if p in place:
                    want[place[p]] += n * w / sum(weights)
    assert np.allclose(pieces.expected(signs, starts, sizes, counts)[:-1], want[:-1])


def test_language_fit_takes_nulls_and_clashing_columns(spark):
    rows = [("en", "the house and the garden", "x"), ("de", "das haus und der garten", "x"), (None, "der", "x"), ("fr", None, "x"), ("it", "12 !", "x"), ("", "la casa", "x")]
    fitted = language.fit(spark.createDataFrame(rows * 5, "lang string, text string, word string"))
    assert fitted.languages == ["", "de", "en"] and np.allclose(fitted.chance.sum(0), 1)
    docs = spark.createDataFrame([(1, "the garden " * 30_000), (1, "der garten"), (2, "x" * 5000)], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(docs, fitted).where("doc_id = 1").collect()} == {"en", "de"}
    none = language.fit(spark.createDataFrame([], "lang string, text string"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, none).collect()} == {("und", 0.0)}


# --- toxicity ---


def naive_hits(lexicon, text):
    """The heaviest term that begins at each place, without those inside exception phrases, by comparing letters. A sign between two words parts a phrase."""
    line = toxicity.folded([text])
    best = {}
    for i in range(len(line)):
        fits = [(w, i + len(t) - (t[-1] == " ")) for t, w in lexicon.terms.items() if line.startswith(t, i)]
        if fits:
            best[i] = max(fits)
    for phrase in lexicon.exceptions:
        for i in range(len(line)):
            if line.startswith(f" {phrase} ", i):
                best = {at: (w, end) for at, (w, end) in best.items() if not (i <= at and end <= i + len(phrase) + 1)}
    return sum(w for w, _ in best.values()), len(line.split())


def test_toxic_hits_against_a_naive_matcher():
    rng = random.Random(4)
    words = ["idiot", "idiots", "trash", "can", "scum", "bag", "trashy", "clown", "fish", "a", "be"]
    spell = lambda w: "".join(rng.choice({"i": "i1!І", "o": "o0о", "a": "a4@а", "s": "s$5", "c": "cсC"}.get(c, c)) for c in w)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idio": 1.5, " trash ": 2.0, " tras": 1.0, " scum ": 2.5, " clown ": 1.0}, [toxicity.folded_phrase(x) for x in ("trash can", "clown fish", "be a clown")])
    texts = [" ".join(spell(rng.choice(words)) + rng.choice(["", "", "."]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts = [t for t in texts if not re.search(r"[0-9!@$](?![^\W\d_])", t)] + ["", "..."]  # signs at a word's end stand for nothing
    sums, n = toxicity.features(lexicon.automaton(), texts)
    for i, t in enumerate(texts):
        assert (pytest.approx(sums[i]), n[i]) == naive_hits(lexicon, t), t


def test_toxicity_learns_terms_and_exceptions(spark):
    rng = random.Random(6)
    plain = ["sun", "tree", "road", "fish", "stone", "river", "wind"]
    text = lambda *more: " ".join(rng.sample([*(rng.choice(plain) for _ in range(12)), *more], 12 + len(more)))
    rows = [(i, text("blarg" if i % 2 else "BL4RG"), 1) for i in range(60)] + [(100 + i, text("blarg finch") if i % 4 == 0 else text(), 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 9, 9.0) for i, t, _ in rows] + [(500, None, 9, 9.0), (None, "blarg", 9, 9.0)], "doc_id long, text string, key int, score double")
    labels = spark.createDataFrame([(i, y, 9) for i, _, y in rows] + [(500, 0, 9), (None, 1, 9), (7000, None, 9)], "doc_id long, toxic int, text int")
    lexicon = toxicity.fit(docs, labels)
    assert toxicity.folded_phrase("blarg") in {t.strip() for t in lexicon.terms} and any("finch" in x and "biarg" in x for x in lexicon.exceptions)
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame([(1, "you blarg"), (2, "a blarg finch sings"), (3, None), (4, "")], "doc_id long, text string"), lexicon, ["doc_id"]).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] < 0.5
    empty = toxicity.fit(docs.where("false"), labels)
    assert toxicity.scored(docs.where("false"), empty, ["doc_id"]).count() == 0


def test_thinned_classes_keep_their_share(spark):
    rng = random.Random(8)
    text = lambda *more: " ".join(["".join(rng.choices("bcdfgh", k=7)) for _ in range(12)] + [*more])
    rows = [(i, text("vilewort"), 1) for i in range(200)] + [(1000 + i, text("vilewort") if i % 40 == 0 else text(), 0) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, text("vilewort")), (2, text())], "doc_id long, text string")
    whole, thin = ({r.doc_id: r.score for r in toxicity.scored(probe, toxicity.fit(docs, labels, max_rows=n), ["doc_id"]).collect()} for n in (10**6, 300))
    # 200 of 275 documents with the word are toxic, whatever part of the clean ones is in the sample
    assert 0.6 < whole[1] < 0.85 and abs(whole[1] - thin[1]) < 0.15
    assert whole[2] < 0.1 and thin[2] < 0.1


# --- PII ---


def test_surrogates_against_planted_entities(spark):
    """Texts with known entities: the rest of the text stays; one surrogate an entity everywhere, none shared, none an entity; format, gender and script stay."""
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    people = [("Mr", "Jones"), ("Mrs", "Baker"), ("Господин", "Петров"), ("Frau", "Müller")]
    phones = [digits(3).replace("0", "5").replace("1", "6") + digits(3) + digits(4) for _ in range(8)]
    plant = [("phone", p, f) for p in phones for f in ("{0}-{1}-{2}", "({0}) {1}-{2}", "{0}.{1}.{2}")]
    plant += [("email", f"u{i}@example{i}.org", None) for i in range(6)] + [("ssn", f"{digits(3)}-{digits(2)}-{digits(4)}", None) for _ in range(5)] + [("ip", f"10.{i}.3.{i + 1}", None) for i in range(5)]
    rows, want = [], []
    for i in range(60):
        kind, value, form = rng.choice(plant)
        shown = form.format(value[:3], value[3:6], value[6:]) if form else value
        title, name = rng.choice(people)
        rows.append((i, f"note x: {shown} ; {title} {name} said so."))
        want.append((kind, value, shown, title, name))
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    seen = defaultdict(set)
    for i, (kind, value, shown, title, name) in enumerate(want):
        text, n = got[i]
        m = re.fullmatch(r"note x: (.+) ; (\S+) (\S+) said so\.", text)
        assert m and n == 2 and m[2] == title, text
        mark = lambda s: re.sub(r"\d", "0", s)
        assert kind in ("email", "ip") or mark(m[1]) == mark(shown)
        seen[kind, value].add(re.sub(r"\D", "", m[1]) if kind == "phone" else m[1])
        seen["name", name].add(m[3])
        assert m[3][0].isupper() and bool(re.match("[А-Я]", m[3])) == bool(re.match("[А-Я]", name))
    assert all(len(x) == 1 for x in seen.values())
    surrogates = Counter(next(iter(x)) for x in seen.values())
    assert max(surrogates.values()) == 1 and not set(surrogates) & {v for _, v in seen}
    again = pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "other").where("doc_id = 0").first().text
    assert again != got[0][0]


def test_crowded_kinds_are_drawn_anew(spark):
    """More entities than half of a format's room: every surrogate is still its own."""
    found = spark.range(60_000).selectExpr("'phone' as kind", "lpad(cast(id + 10000 as string), 5, '0') as norm")
    found = found.unionByName(spark.range(3000).selectExpr("'family_latin' as kind", "concat('n', id) as norm"))
    found, key = found.withColumn("gender", F.lit("n")), pii.secret(spark, "k")
    drawn = pii._drawn(found.join(pii.drawn_anew(found, key).drop("gender"), ["kind", "norm"], "left").withColumn("draw", F.expr("coalesce(draw, 0)")), key)
    r = drawn.agg(F.count("*").alias("n"), F.count_distinct("kind", "surrogate").alias("d")).first()
    assert r.n == r.d == 63_000


def test_one_person_has_one_name(spark):
    """A given name has one surrogate whatever the form of address tells, and names are replaced in their bare mentions, in their own document only."""
    texts = ["Dr Anna Weber met Frau Anna Weber. Anna went; Weber said: Webern is no Weber.", "Herr MÜLLER and mr John Smith left. Smithy and John!", "Dr Ελένη Παπαδοπούλου", "Dr Anna Weber", "Weber lives here.", "password = hunterhunter", "to a" + "b" * 90 + "@x.org", "Dr " + "A" + "b" * 60 + " Zed"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    changed = pii.replace_entities(df, "a very secret key")
    assert "a very secret key" not in changed._jdf.queryExecution().toString()
    got = {r.doc_id: r.text for r in changed.collect()}
    m = re.fullmatch(r"Dr (\w+) (\w+) met Frau (\w+) (\w+)\. (\w+) went; (\w+) said: Webern is no (\w+)\.", got[0])
    assert m[1] == m[3] == m[5] and m[2] == m[4] == m[6] == m[7] and m[1].endswith("na") and m[1] != "Anna"
    assert got[3] == f"Dr {m[1]} {m[2]}" and got[4] == texts[4]
    n = re.fullmatch(r"Herr (\w+) and mr (\w+) (\w+) left\. Smithy and (\w+)!", got[1])
    assert n[2] == n[4] and not {"MÜLLER", "John", "Smith"} & set(n.groups())
    assert re.fullmatch(r"Dr [Α-Ω][α-ως]+ [Α-Ω][α-ως]+", got[2]) and "Ελένη" not in got[2]
    assert "hunter" not in got[5] and "bbb" not in got[6] + got[7] and not got[7].endswith("Zed")


@pytest.fixture()
def cluster(spark, monkeypatch):
    """The session as if its master were another machine."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    yield spark
    vars(spark.sparkContext).pop("_skysweep_surrogate_key", None)


def test_pipeline_replaces_entities_on_a_cluster_without_a_key(cluster):
    """Stage 3 runs with a key of the application's own: the same in each run, not the one that sessions on one machine have, and not in the plan; a key that is set holds."""
    docs = cluster.createDataFrame([(0, "Write to anna@web.org or +1 415 555 0123."), (1, "anna@web.org is gone"), (2, "plain"), (3, None)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["pii"]
    changed = stage(cluster, docs, "")
    got = {r.doc_id: r.text for r in changed.collect()}
    assert "anna" not in got[0] + got[1] and "555" not in got[0] and got[0].split()[2] == got[1].split()[0] and (got[2], got[3]) == ("plain", None)
    assert got == {r.doc_id: r.text for r in stage(cluster, docs, "").collect()}
    key = queries.surrogate_key(cluster)
    assert len(key) == 64 and key not in changed._jdf.queryExecution().toString()
    public = {r.doc_id: r.text for r in pii.replace_entities(docs, "no secret: set spark.skysweep.surrogateKey", count=None).collect()}
    assert got[0] != public[0] and got[1] != public[1]
    cluster.conf.set("spark.skysweep.surrogateKey", "k")
    try:
        assert queries.surrogate_key(cluster) == "k"
        cluster.conf.set("spark.skysweep.surrogateKey", "")
        assert queries.surrogate_key(cluster) == key
    finally:
        cluster.conf.unset("spark.skysweep.surrogateKey")


def test_op10_finds_the_same_entities_on_a_cluster_without_a_key(cluster):
    """op10 runs over whole tables under another machine's name, and replaces what it replaces with any other key."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op10_pii"](cluster, sf).collect()}
    want = {r.doc_id: r for r in pii.replace_entities(cluster.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "k").collect()}
    assert {i: r.n_entities for i, r in got.items()} == {i: r.n_entities for i, r in want.items()} and len(got) == 200
    assert all((r.text == want[i].text) == (r.n_entities == 0) for i, r in got.items()) and any(r.n_entities for r in got.values())


def test_substitutions_at_the_end_of_a_word():
    """Digits and signs stand for letters before and behind letters, in runs of any length; a word's plain reading counts as well."""
    found = toxicity.Lexicon({" hate ": 2.0, " ass ": 3.0, " dog ": 1.0, " fooi ": 5.0, " sss": 4.0}).automaton()
    texts = ["h4t3 a$$, dog5", "hate", "a dog! fool5 fool!", "$" * 9000 + "x", None, "d0g", "5 5 $ 7", "ＡＳ＄", "x" + "0" * 9000]
    assert toxicity.features(found, texts)[0].tolist() == [6.0, 2.0, 11.0, 4.0, 0.0, 1.0, 0.0, 3.0, 0.0]


# --- packing ---


@pytest.mark.parametrize("seed", range(40))
def test_windows_hold_every_id_once_and_stay_full(seed):
    rng = random.Random(seed)
    totals = [rng.randint(1, 400) for _ in range(rng.randint(1, 5))]
    weights = None if seed % 3 == 0 else [rng.choice([0.0, 0.1, 0.5, 3.0]) for _ in totals]
    size = rng.choice([7, 64, 1000])
    rounds, line = packing.proportional(totals, size, weights), set()
    for q, n in enumerate(totals):
        for p in range(n):
            first, stop, begin = rounds.slices(rounds.window(q, p))
            assert first[q] <= p < stop[q]
            line.add(begin[q] + p - first[q])
    assert line == set(range(sum(totals)))
    assert all(abs(sum(rounds.served(k)) - k * size) <= len(totals) for k in range(sum(totals) // size))


def test_a_spent_queue_hands_over_its_quantum():
    rounds = packing.proportional([100, 1000], 64, [0.9, 0.1])
    assert [[b - a for a, b in zip(rounds.served(k), rounds.served(k + 1), strict=True)] for k in range(4)] == [[57, 6], [43, 22], [0, 64], [0, 64]]
    for bad in ([1.0, -1.0], [float("nan"), 1.0]):
        with pytest.raises(ValueError):
            packing.proportional([1, 2], 64, bad)


def test_packing_with_weights(spark):
    rows = [(i % 50, f"s{i % 4}" if i % 5 else None, "word " * (i % 30)) for i in range(300)] + [(None, "s1", "same text")] * 20 + [(7, "s2", None), (8, "s3", "long " * 20_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, source string, text string, queue int, place int")
    for weights in (None, {"s1": 3.0, "s2": 1.0}, {"absent": 1.0}):
        lines = defaultdict(list)
        pieces = packing.pack(docs, length=64, weights=weights).collect()
        for r in pieces:
            lines[r.sequence_id].append((r.offset, r.length))
        assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == len(rows)
        for parts in lines.values():
            ends = list(itertools.accumulate(n for _, n in sorted(parts)))
            assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]]


def test_a_thousand_sources_and_their_weights(spark):
    """Every source has a queue of its own: those with weights come first, in their proportion, whatever their size."""
    rows = [(i, f"s{i % 1000:03}", "word " * 40) for i in range(4000)] + [(5000 + i, "s000", "word " * 300) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string")
    last = {}
    for r in packing.pack(docs, length=4, weights={"s998": 1.0, "s999": 1.0, "none": 5.0}).collect():
        last.setdefault(r.source, []).append(r.window)
    assert len(last) == 1000 and max(last["s998"] + last["s999"]) <= 4 and min(map(min, (v for k, v in last.items() if k not in ("s998", "s999")))) >= 2


def test_the_mix_that_is_passed_on_comes_near_the_targets(spark):
    """Whole documents, some very long: of each source with enough short ones within 2 % of what the mix takes."""
    rng = random.Random(8)
    sizes = [rng.choice([3, 20, 60, 200, 900]) for _ in range(1200)] + [6000, 9000, 20_000]
    rows = [(i, f"src{i % 3}", f"w{i} " * n) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text_ string, text string").selectExpr("doc_id", "text_ as source", "text", "0 as bucket", "'x' as size")
    out = corpus_pipeline.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.source: r.n for r in out.groupBy("source").agg(F.sum(mixing.word_count()).alias("n")).collect()}
    want = {r.source: (r.target, r.taken) for r in mixing.mix(docs, keep=["doc_id", "source", "text"]).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    for source, (target, taken) in want.items():
        assert abs(got[source] - taken) <= 0.01 * taken and abs(got[source] - target) <= 0.02 * target
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 3


# --- all ---

NAMES = "score row hits new words target block quota size lang_pred letters_score n_entities kind norm draw surrogate source_size taken bands key queue place n rep component cid n_ times kept kept_id".split()


@pytest.fixture(scope="module")
def many(spark):
    """Documents with nulls, empty and long texts, repeats, and columns named as those of the operators."""
    rng = random.Random(2)
    english = "the house stands near the river and the people of the town walk along the road to the market every day".split()
    german = "das haus steht am fluss und die leute aus der stadt gehen jeden tag auf der strasse zum markt".split()
    rows = []
    for i in range(60):
        words = english if i % 2 else german
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        rows.append((i, text + (f" Mr Smith, call 555-123-4{i:03}" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}" if i % 4 else None, len(text)))
    rows += [(100, rows[0][1], "de", "s0", 1), (101, None, None, None, None), (102, "", "en", "s1", 0), (None, rows[3][1], None, None, 1), (5, rows[7][1], "en", "s1", 1), (5, rows[7][1], "en", "s1", 1), (103, rows[1][1] + " more words" * 20_000, "en", "s2", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return frame.select("*", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in NAMES])


def test_columns_come_back(many):
    own, names, back = aside(many, "text")
    assert back(own).schema == many.schema and set(names) & set(NAMES) == set()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_columns_and_empty_tables(spark, many, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (many, many.where("false")):
        out = stage(spark, docs, "")
        if name == "packing":
            assert sum(r.start == 0 for r in out.collect()) == docs.count()
            continue
        assert out.columns == docs.columns
        rows = out.collect()
        for r in rows:
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in NAMES)
        ids = Counter(r.doc_id for r in rows)
        before = docs.count()
        if not before:
            assert not rows
        elif name == "language_id":
            assert ids == Counter(r.doc_id for r in docs.where("text <> ''").collect())
        elif name == "near_duplicates":
            assert 100 not in ids and ids[5] <= 1 and ids[None] == 1 and max(ids.values()) == 1 and {101, 102} <= set(ids)
        elif name == "pii":
            assert len(rows) == before and not any("Smith" in (r.text or "") for r in rows) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        elif name == "mixing":
            assert ids and max(ids.values()) <= 9 and all(r.text for r in rows)


def test_operators_take_clashing_columns(spark, many):
    assert pii.replace_entities(many, "k").columns[-1] == "n_entities" and pii.replace_entities(many, "k").count() == many.count()
    assert mixing.mix(many).count() == many.count() and neardup.near_duplicates(many).count() == many.count()
    assert substrings.remove_repeats(many).count() == many.count()
    vectors = many.selectExpr("doc_id as vec_id", "array(double(n_chars), 1D) as embedding", "1 as label", "*")
    assert embdup.near_duplicates(vectors).count() == vectors.count()
    whole = topk.integers(vectors)
    assert {r["rank"] for r in topk.top_k(whole, whole.where("vec_id % 50 = 0")).collect()} == {1, 2, 3, 4, 5}
    pages = many.selectExpr("doc_id as page_id", "concat('http://', doc_id) as url", "text as html", "*")
    files = warc.write_archive(pages, warc.archive_folder(pages))
    assert warc.read_archive(files).count() == pages.count()


def test_empty_tables(spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    whole = topk.integers(vectors)
    assert embdup.near_duplicates(vectors).count() == topk.top_k(whole, whole).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(warc.write_archive(pages, warc.archive_folder(pages))).count() == 0


def test_ties_in_search_and_groups(spark):
    """Equal vectors: ties go to the smaller id, and all copies are linked."""
    rows = [(i, [1.0, float(i % 2)], 1) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = topk.integers(frame)
    got = defaultdict(list)
    for r in topk.top_k(whole, whole.where("vec_id % 50 = 0")).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert sorted(got[0]) == [(i + 1, i + 1) for i in range(5)] and sorted(got[50]) == [(i + 1, i) for i in range(5)]
    links = {r.vec_id: (r.n_links, r.component_id) for r in embdup.near_duplicates(frame).collect()}
    assert links == {i: (29, i % 2) for i in range(60)}


def test_chance_of_equal_registers():
    """The correction against simulated unrelated sets of several sizes."""
    rng = np.random.default_rng(5)
    for na, nb in ((300, 300), (2000, 2000), (2000, 1500)):
        same = [np.mean((x := neardup.registers(np.unique(rng.integers(0, 2**64, na, np.uint64)))) == (y := neardup.registers(np.unique(rng.integers(0, 2**64, nb, np.uint64))))) if True else (x, y) for _ in range(400)]
        both_empty = np.exp(-(na + nb) / neardup.REGISTERS)
        want = neardup.by_chance(np.array([na]), np.array([nb]))[0]
        assert abs(np.mean(same) - both_empty - want) < 5 * np.sqrt((want + both_empty) / (400 * neardup.REGISTERS))
