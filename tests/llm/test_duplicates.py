"""Jaccard components and repeated passages against brute force."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import COLUMNS, texts_of

from convosieve.llm import common, graphs, jaccard, repeats


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = split(low(text))
    k = min(size, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    own = list(range(len(rows)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                own[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = lambda v: min((x for x in v if x is not None), default=None)
    return Counter((d, len(sets[i]), least(ids[root(i)])) for i, (d, _) in enumerate(rows))


def edited(seed=3):
    """Chains and clusters of copies with a few words changed, over a passage that all share."""
    rng, rows = random.Random(seed), []
    shared = " ".join(f"common{i}" for i in range(40))
    for base in range(12):
        text = [f"b{base}w{rng.randrange(60)}" for _ in range(150)]
        for _ in range(9):
            rows.append((len(rows), " ".join(text) + " " + shared))
            for _ in range(rng.randrange(5)):
                text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
    return rows


@pytest.fixture(scope="session")
def near(spark):
    return spark.createDataFrame(edited(), "doc_id long, text string")


@pytest.mark.parametrize(("name", "size", "percent"), [("awkward", 3, 90), ("near", 3, 90), ("near", 5, 80), ("empty", 5, 80), ("documents", 5, 80)])
def test_components_are_exact(request, name, size, percent):
    docs = request.getfixturevalue(name)
    got = jaccard.similar(docs, size, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(texts_of(docs), size, percent)


def test_groups_do_not_hide_links(near, monkeypatch):
    """The same without leaders, so that all links come from the matrix."""
    expected = brute_components(texts_of(near), 3, 90)
    monkeypatch.setattr(jaccard.Join, "group_links", lambda self: self.nodes.selectExpr("node AS a", "node AS b").limit(0))
    got = jaccard.similar(near, 3, 90).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected


@pytest.mark.parametrize("name", ["awkward", "near", "empty"])
def test_one_of_each(request, name):
    docs = request.getfixturevalue(name)
    kept = jaccard.one_of_each(docs)
    assert kept.schema == docs.schema
    rows = texts_of(docs)
    components = {(d, n, c) for d, n, c in brute_components(rows, 5, 80) if n}
    blank = sum(not split(t) for _, t in rows)
    names = {c if c is not None else ("no id", d) for d, _, c in components}
    assert kept.count() == blank + len(names)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 90), (90, 100)], "a long, b long")
    got = {(r["node"], r["component"]) for r in graphs.components(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(90, 90), (100, 90)}


def brute_spans(rows, length):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    order = lambda d: (d is not None, d or 0)
    least = {t: min((d for d in ids if d is not None), default=None) for t, ids in texts.items()}
    seen = defaultdict(list)
    for t in texts:
        w = split(t)
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])].append((order(least[t]), t, i))
    out = Counter()
    for t, ids in texts.items():
        w = split(t)
        if len(w) < length:
            continue
        first, later = [False] * len(w), [False] * len(w)
        for i in range(len(w) - length + 1):
            found = seen[tuple(w[i : i + length])]
            if len(found) > 1:
                mark = first if min(found)[1:] == (t, i) else later
                mark[i : i + length] = [True] * length
        later = [b and not a for a, b in zip(first, later)]
        if len(ids) > 1:
            first = [not b for b in later]
        for d in ids:
            if d != least[t]:
                out[d, 0, len(w), False] += 1
                continue
            for flags, kind in ((first, True), (later, False)):
                for m in re.finditer("1+", "".join("01"[f] for f in flags)):
                    out[d, m.start(), m.end(), kind] += 1
    return out


@pytest.fixture(scope="session")
def passages(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    common, exact = words(60), words(50)
    rows = [(i, f"{words(rng.randrange(120))} {common} {words(rng.randrange(80))} {exact if i % 3 else words(49)}\n{words(5)}") for i in range(40)]
    rows += [(40, common), (41, exact), (42, common), (43, " ".join(exact.split()[:49])), (44, f"{exact} {exact}"), (45, "la " * 200), (None, f"{words(9)} {common}")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["awkward", "passages", "empty", "documents"])
def test_spans_are_exact(request, name):
    docs = request.getfixturevalue(name)
    got = Counter(tuple(r) for r in repeats.spans(docs).collect())
    assert got == brute_spans(texts_of(docs), 50)


def test_cut_leaves_one_copy(spark, passages):
    left = repeats.cut(passages)
    assert left.schema == passages.schema
    seen = Counter()
    for _, t in texts_of(left):
        w = split(t)
        seen.update(tuple(w[i : i + 50]) for i in range(len(w) - 49) if "la" not in w)
    before = Counter()
    for _, t in texts_of(passages):
        w = split(t)
        before.update({tuple(w[i : i + 50]) for i in range(len(w) - 49) if "la" not in w})
    assert all(n == 1 for n in seen.values())
    assert {w for run in before for w in run} == {w for _, t in texts_of(left) for w in split(t) if w != "la"} & {w for run in before for w in run}


@pytest.mark.parametrize("size", [50, 60, 80, 98, 120])
def test_cut_of_nested_passages(spark, size):
    """P in doc 1, Y P X in docs 2 and 3: no passage is left twice and no word is lost, also where P is periodic."""
    words = lambda kind, n: " ".join(f"{kind}{i}" for i in range(n))
    p, y, x, a = words("p", size), words("y", 70), words("x", 60), words("a", 40)
    rows = [(1, f"{words('b', 9)} {p} {words('c', 9)}"), (2, f"{words('d', 55)} {y} {p} {x}"), (3, f"{y} {p} {x} {words('e', 55)}")]
    rows += [(4, f"{words('f', 55)} {y[::-1]} {a} {a} {a} {x[::-1]}"), (5, f"{y[::-1]} {a} {a} {a} {x[::-1]} {words('g', 55)}"), (6, "la " * 200)]
    left = dict(texts_of(repeats.cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))))
    seen = Counter(run for t in left.values() for run in (tuple(split(t)[i : i + 50]) for i in range(len(split(t)) - 49)))
    assert set(seen.values()) == {1}
    assert {w for _, t in rows for w in split(t)} == {w for t in left.values() for w in split(t)}
    assert left[1] == rows[0][1] and split(left[2]) == split(f"{words('d', 55)} {y} {x}") and split(left[3]) == split(words("e", 55))
    assert split(left[6]) == ["la"] * 50


def test_cut_keeps_columns_and_lengths(awkward, empty):
    left = repeats.cut(awkward)
    assert left.schema == awkward.schema and repeats.cut(empty).count() == 0
    short = {(d, t) for d, t in texts_of(awkward) if len(split(t)) < 50}
    assert short <= set(texts_of(left))


def test_schema_of_fixture(awkward):
    assert len(COLUMNS.split(", ")) == len(awkward.columns)


def test_steps_leave_little_behind(spark, documents, monkeypatch):
    """Tables of steps go once their readers are stored; tokens of one node are counted alike in any number of passes."""
    made = []
    monkeypatch.setattr(repeats, "stored", lambda df: made.append(common.stored(df)) or made[-1])
    rows, found = repeats.repeated_texts(documents, 10)
    assert {t._stored_at for t in made if os.path.exists(t._stored_at.removeprefix("file:"))} == {rows._stored_at, found._stored_at}
    sets = spark.createDataFrame([(1, [-5, 2, 3, 8]), (1, [-5, 2, 3, 8]), (2, [2, 7, 8, -9]), (3, [4])], "node long, tokens array<long>")
    for passes in (1, 2, 3):
        monkeypatch.setattr(jaccard, "PASSES", passes, raising=False)
        assert sorted(tuple(r) for r in jaccard._alone(sets, "tokens").collect()) == [(1, 2), (2, 2), (3, 1)]
