"""Quality rules, quality ranking and language models: definitions, awkward rows, held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import texts_of

from convosieve.llm import crf, pairwise, quality_rules


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = split(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines, dups = set(), 0
    for line in text.split("\n"):
        if split(line):
            dups += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_base_rules(request, name):
    docs = request.getfixturevalue(name)
    got = Counter(tuple(r)[:7] for r in quality_rules.report(docs).collect())
    assert got == Counter((d, *base(t)) for d, t in texts_of(docs))


def test_divergence_is_the_definition(documents):
    known = quality_rules.references(documents)
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert quality_rules.js_distance(p, q) == pytest.approx(np.sqrt(0.5)) and quality_rules.js_distance(p, p) == 0
    counts = Counter()
    for r in documents.where("lang = 'en'").collect():
        counts.update(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in r["text"] or "")))
    total = sum(counts.values())
    common = {w.encode() for w, n in counts.items() if n >= quality_rules.COMMON_SHARE * total}
    places, shares = next(k for k in known.words if b"the" in k[0])
    assert set(places) == common and shares[places[b"the"]] == pytest.approx(counts["the"] / total) and shares.sum() == pytest.approx(1)


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_accepted_keeps_rows_whole(request, name):
    docs = request.getfixturevalue(name)
    kept = quality_rules.accepted(docs)
    assert kept.schema == docs.schema
    fine = Counter(r["doc_id"] for r in quality_rules.report(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == fine


def test_rules_keep_good_documents(spark, data):
    found = quality_rules.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert all(good) and sum(bad) < 0.6 * len(bad)


def rare_language(n=30, seed=4):
    """Good texts of a language with words of its own, common ones among them."""
    rng = np.random.default_rng(seed)
    often, seldom = ([f"{kind}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] for kind in ("zu", "mkhon"))
    return [" ".join(often[int(w) % 10] if k % 2 else seldom[int(w)] for k, w in enumerate(rng.integers(0, 200, 300))) for _ in range(n)]


@pytest.mark.parametrize("languages", [1000, 1])
def test_rules_keep_good_documents_of_rare_languages(spark, documents, data, monkeypatch, languages):
    monkeypatch.setattr(quality_rules, "LANGUAGES", languages, raising=False)  # 1: a block for about every language
    planted = [(10**6 + i, t, "zu") for i, t in enumerate(rare_language())] + [(2 * 10**6, " ".join(f"unlike{i}" for i in range(300)), None)]
    docs = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(planted, "doc_id long, text string, lang string"))
    rows = {r["doc_id"]: r for r in quality_rules.report(docs).collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()} | {p[0] for p in planted}
    fine = {d for d in good if d in rows and not rows[d]["base_failed"]}
    assert fine >= {p[0] for p in planted} and all(rows[d]["kept"] for d in fine)
    assert fine <= {r["doc_id"] for r in quality_rules.accepted(docs).collect()}
    known = quality_rules.references(docs)
    assert len(known.words) == len(known.classes) == 5
    least = min(quality_rules.distances(planted[0][1].encode(), quality_rules.class_counts(planted[0][1].encode()), known))
    assert least in (rows[10**6]["class_distance"], rows[10**6]["word_distance"])


def held(doc_id, parts):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % parts


def test_quality_ranking(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = pairwise.scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (held(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95


def test_quality_never_reads_held_out_labels(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(pairwise.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r["doc_id"], r["score"]) for r in pairwise.scores(documents, x).collect()} for x in (labels, flipped))
    assert one == two


def test_quality_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (5, 9), (10, 1)], "doc_id long, quality int")
    none = labels.limit(0)
    assert pairwise.scores(awkward, labels).count() == awkward.count()
    assert {round(r["score"], 9) for r in pairwise.scores(awkward, none).collect()} == {0.3}
    assert pairwise.scores(empty, labels).count() == 0


def test_ranking_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.logistic(size=500) * 0.3 > 0).astype(int)
    found = pairwise.fit(x, y)
    assert found.weights[0] > 0 > found.weights[1] and abs(found.weights[2]) < 0.3 * found.weights[0]
    assert np.mean((found.of(x) >= found.threshold) == y) > 0.85


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = crf.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert all(r["held_out"] == (held(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean(out) > 0.97


def test_language_awkward(spark, awkward, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in crf.languages(awkward).collect()}
    by_id = dict(got)
    assert len(got) == len({d for d, _ in texts_of(awkward)})
    assert all((by_id[d] == "und") == (not any(c.isalpha() for c in t or "")) for d, t in texts_of(awkward))
    assert {r["lang_pred"] for r in crf.languages(awkward.withColumn("lang", awkward["source"].substr(9, 1)).where("lang <> ''")).collect()} <= {"und"}
    assert crf.languages(empty).count() == 0


def chain(e, t):
    """Marginals by summing over all paths."""
    from itertools import product

    n, k = e.shape
    out = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        weight = sum(t[s, path[0]] for s in range(k)) / k * np.prod([e[i, path[i]] for i in range(n)]) * np.prod([t[path[i - 1], path[i]] for i in range(1, n)])
        for i, s in enumerate(path):
            out[i, s] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_by_enumeration(monkeypatch):
    rng = np.random.default_rng(2)
    t, e = np.exp(rng.normal(size=(3, 3))), np.exp(rng.normal(size=(2, 6, 3)))
    marginals, moves = crf._forward_backward(e, t)
    assert np.allclose(marginals[1], chain(e[1], t)) and moves.sum() == pytest.approx(12)
    monkeypatch.setattr(crf, "BLOCK", 4)
    words = ["a", "bb", "ccc", "d", "ee", "fff", "g"]
    model = crf.Model(["x", "y", "z"], {}, rng.normal(size=(crf.BUCKETS, 3)), np.log(t))
    tagger = crf.Tagger(model)
    shares = tagger.shares([words, words[:2], words[:4]])
    potentials = lambda own: np.exp(np.array([model.weights[crf.feature_ids(w, {})].sum(axis=0) for w in own]))
    for got, own in zip(shares, (words, words[:2], words[:4])):
        assert np.allclose(got, chain(potentials(own), t).mean(axis=0))


def speech(draw, language, n):
    """Words of an invented language: its own syllables."""
    syllables = [chr(97 + language % 26) + v + chr(97 + language // 26) for v in "aeiou"]
    return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(n))


def test_every_language_is_learned_from(spark):
    """However many there are: the rows are bounded, not the languages."""
    draw = random.Random(11)
    rows = [(lang * 10 + i, speech(draw, lang, 6), f"l{lang}") for lang in range(400) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known = {lang for d, _, lang in rows if held(d, 4) != 2}
    assert len(known) > 390 and {lang for lang, _ in crf.sample(docs, 250, 4, 2)} == known
    few = crf.sample(docs, 250, 4, 2, fit_rows=450)
    assert {lang for lang, _ in few} == known and len(few) == len(known)


def test_runs_of_languages_in_one_text(spark):
    draw = random.Random(12)
    rows = [(i, speech(draw, i % 3, 30), f"l{i % 3}") for i in range(120)]
    mixed = [(1000 + i, speech(draw, 0, 10) + " " + speech(draw, 1, 15) + ", " + speech(draw, 2, 8), None) for i in range(6)] + [(2000, None, None), (2001, " 12 ", None)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string").repartition(3)
    spans = {}
    for r in sorted(crf.word_languages(docs).collect()):
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["lang"]))
        assert 0 < r["score"] <= 1
    for i in range(6):
        assert spans[1000 + i] == [(0, 10, "l0"), (10, 25, "l1"), (25, 33, "l2")]
    assert 2000 not in spans and 2001 not in spans and all(s[0][0] == 0 and s[-1][1] == 30 for d, s in spans.items() if d < 1000)
    best = {r["doc_id"]: r["lang_pred"] for r in crf.languages(docs).collect()}
    assert all(best[1000 + i] == "l1" for i in range(6)) and best[2000] == best[2001] == "und"
