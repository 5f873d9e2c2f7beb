import numpy as np
import pytest
from pyspark.sql import functions as F

from convosieve.operators import neighbors as N
from convosieve.operators import similarity as D


def top(sims, ids, k):
    """(id, similarity) of the k best; ties go to the smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (-round(sims[i], 6) + 0.0, ids[i]))[:k]
    return [(ids[i], round(sims[i], 6)) for i in order]


# --- sparse -----------------------------------------------------------------------


def corpus(seed, rows, vocabulary, copies=0):
    """Texts of words with the frequencies of a language, and some copies of one text."""
    draw = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(vocabulary)])
    weights = 1 / np.arange(1, vocabulary + 1)
    texts = [" ".join(draw.choice(words, draw.integers(5, 60), p=weights / weights.sum())) for _ in range(rows)]
    return texts + [texts[0]] * copies


def frames(spark, train, test):
    return [D.add_keys(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)) for t in (train, test)]


def plain(train, test, k):
    docs = [t.split() for t in [*train, *test]]
    bags = [w + [" ".join(p) for p in zip(w, w[1:])] for w in docs]
    df = {}
    for b in bags:
        for g in set(b):
            df[g] = df.get(g, 0) + 1
    vocab = {g: i for i, g in enumerate(g for g, n in df.items() if n >= 2)}
    m = np.zeros((len(bags), len(vocab)))
    for row, b in zip(m, bags):
        for g in set(b) & set(vocab):
            row[vocab[g]] = (1 + np.log(b.count(g))) * (np.log((1 + len(bags)) / (1 + df[g])) + 1)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = m[len(train) :] @ m[: len(train)].T
    return {t: top(s, list(range(len(train))), k) for t, s in enumerate(sims)}


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_the_nearest_texts(spark, seed):
    train, test = corpus(seed, 300, 2000, copies=150), corpus(seed + 10, 25, 2000) + ["", "unknown words only", "w0", "w0 w1 w2", "w7 w7 w7"]
    test += [train[0], train[5] + " " + train[6]]
    rows = D.tfidf_neighbors(*frames(spark, train, test), k=4).collect()
    got = {t: [] for t in range(len(test))}
    for r in sorted(rows, key=lambda r: (r["test_id"], r["neighbor_rank"])):
        got[r["test_id"]].append((r["train_id"], r["similarity"]))
    for t, best in plain(train, test, 4).items():
        assert [i for i, _ in got[t]] == [i for i, _ in best] and [s for _, s in got[t]] == pytest.approx([s for _, s in best], abs=1.1e-6)


@pytest.mark.parametrize("known, rows, postings", [(0, 1000, 50), (40, 7, 1 << 20)])
def test_blocks_of_queries_find_the_nearest_texts(spark, monkeypatch, known, rows, postings):
    """Whatever a task knows or holds at once, the result is that of all pairs, and repeated ids each have their rows."""
    monkeypatch.setattr(N.nearest_by_terms, "__defaults__", (known, rows, postings))
    train, test = corpus(6, 60, 300, copies=20), [*corpus(7, 8, 300), "", "unknown words only"]
    a, b = frames(spark, train, test)
    got = {t: [] for t in range(len(test))}
    for r in sorted(D.tfidf_neighbors(a, b, k=3).collect(), key=lambda r: (r["test_id"], r["neighbor_rank"])):
        got[r["test_id"]].append((r["train_id"], r["similarity"]))
    for t, best in plain(train, test, 3).items():
        assert [i for i, _ in got[t]] == [i for i, _ in best] and [s for _, s in got[t]] == pytest.approx([s for _, s in best], abs=1.1e-6)
    twice = D.tfidf_neighbors(a.union(a.filter("doc_id = 0")), b, k=60).collect()
    assert sorted(r["neighbor_rank"] for r in twice if r["test_id"] == 0) == list(range(1, 61))
    assert sum(r["train_id"] == 0 for r in twice) in range(0, 2 * len(test) + 1, 2)


def test_no_pair_of_texts_is_shuffled(spark):
    """Only each task's best rows leave it: a few a query, though every text shares a term with every query."""
    a, b = frames(spark, ["the " + t for t in corpus(8, 400, 300)], ["the " + t for t in corpus(9, 20, 300)])
    plan = D.tfidf_neighbors(a, b, k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow scan" in plan and "term" not in plan.split("MapInArrow scan")[0]


def test_few_pairs_are_scored(spark):
    """Queries that resemble something leave most of the corpus unscored, frequent terms notwithstanding."""
    train = corpus(3, 1500, 20_000, copies=300)
    test = [" ".join(t.split()[: len(t.split()) * 2 // 3]) for t in train[1:41]]
    a, b = frames(spark, train, test)
    both = a.select((F.col("doc_id") * 2).alias("id"), "text_norm").union(b.select(F.col("doc_id") * 2 + 1, "text_norm"))
    vectors = D.tfidf_vectors(both, D.GRAMS["word_tfidf_1_2"](F.col("text_norm")), "id").persist()
    side = lambda odd, name: vectors.filter(F.col("id") % 2 == odd).select((F.col("id") / 2).cast("long").alias(name), "terms", "weights")
    pairs = N.candidate_pairs(side(0, "train_id"), side(1, "test_id"), 1)
    assert pairs.count() < 0.02 * len(train) * len(test)
    vectors.unpersist()


def test_bounds_hold_for_every_pair(spark):
    a, b = frames(spark, corpus(4, 80, 300), corpus(5, 10, 300))
    both = a.select((F.col("doc_id") * 2).alias("id"), "text_norm").union(b.select(F.col("doc_id") * 2 + 1, "text_norm"))
    rows = [(r["id"], dict(zip(r["terms"], r["weights"]))) for r in D.tfidf_vectors(both, D.GRAMS["word_tfidf_1_2"](F.col("text_norm")), "id").collect()]
    schema = "id long, terms array<long>, weights array<double>"
    make = lambda odd, name: spark.createDataFrame([(i // 2, sorted(v), [v[t] for t in sorted(v)]) for i, v in rows if i % 2 == odd], schema).withColumnRenamed("id", name)
    found = {}
    for r in N.term_bounds(make(0, "train_id"), make(1, "test_id")).collect():
        found.setdefault(r["test_id"], []).append(r)
    for i, query in rows:
        terms = sorted(found.get(i // 2, []), key=lambda r: r["seen"]) if i % 2 else []
        for n, r in enumerate(terms):
            behind = [x["term"] for x in terms[n + 1 :]]
            for j, doc in rows:
                if j % 2 == 0:
                    added = sum(query[t] * doc.get(t, 0.0) for t in behind)
                    assert added <= min(r["tops"], r["length"]) + 1e-9 and added + query[r["term"]] * doc.get(r["term"], 0.0) <= r["rest"] + 1e-9


# --- near duplicates --------------------------------------------------------------


def sets_of(texts):
    out = {}
    for i, text in texts:
        w = [x for x in " ".join((text or "").lower().split()).split() if len(x) >= 2]
        grams = w if len(w) < 2 else [" ".join(w[j : j + n]) for n in (2, 3) for j in range(len(w) - n + 1)]
        if grams:
            out[i] = frozenset(grams)
    return out


def all_near(texts, max_distance):
    sets, first, out = sets_of(texts), {}, {}
    for i in sorted(sets):
        if first.setdefault(sets[i], i) != i:
            out[first[sets[i]], i] = 0.0
    reps = sorted((i, s) for s, i in first.items())
    for n, (i, a) in enumerate(reps):
        for j, b in reps[n + 1 :]:
            if len(a & b) >= (1 - max_distance) * len(a | b) - 1e-9:
                out[i, j] = 1 - len(a & b) / len(a | b)
    return out


def near(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, gram string, n int").repartition(4)
    return {(r["left_id"], r["right_id"]): r["distance"] for r in D.near_duplicates(docs, **how).collect()}


@pytest.mark.parametrize("max_distance", [0.0, 0.3, 0.6])
def test_near_duplicates_are_complete(spark, max_distance):
    draw, texts = np.random.default_rng(6), corpus(7, 120, 60)
    for t in texts[:60]:
        w = t.split()
        for _ in range(2):
            w[draw.integers(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", " ", "word", "Word", "two words", "TWO  words", "x y", "a " * 30 + "same words here"] + [texts[0]] * 40
    texts += [f"everyone shares this long beginning of a text and only the end differs {i}{i}" for i in range(60)]
    rows = list(enumerate(texts))
    expected = all_near(rows, max_distance)
    got = near(spark, rows, max_distance=max_distance, gram_rows=7)  # frequent grams in parts
    assert got.keys() == expected.keys() and all(got[p] == pytest.approx(d) for p, d in expected.items())
    assert len(expected) > 40


def test_near_duplicates_store_and_shuffle_no_gram_strings(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one two three five"), (3, "one")], "doc_id long, text string")
    sets = D.gram_sets(docs)
    assert {r["id"]: r["n"] for r in sets.collect()} == {1: 5, 2: 5, 3: 1} and "array<string>" not in dict(sets.dtypes).values()
    prefixes = D._prefixes(sets.select("id", "n", "text"), 0.2)
    assert dict(prefixes.dtypes)["gram"] == "bigint" and {r["id"] for r in prefixes.collect()} == {1, 2}


def test_near_duplicates_of_nothing(spark):
    assert near(spark, []) == {} and near(spark, [(1, None), (2, ""), (3, " \n")]) == {}


# --- dense ------------------------------------------------------------------------


def vectors(spark, rows, name="embedding"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "clash", 1, 2.0) for i, v in rows], f"vec_id long, {name} array<float>, block string, centre int, far double").repartition(4)


def clustered(seed, n, dim=16, clusters=12, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dim))
    return [centres[draw.integers(clusters)] + spread * draw.normal(size=dim) for _ in range(n)]


def nearest(train, test, k):
    unit = lambda rows: np.array([np.asarray(v, np.float32).astype(float) / max(np.linalg.norm(np.asarray(v, np.float32).astype(float)), 1e-300) for _, v in rows])
    sims = unit(test) @ unit(train).T
    return {t: top(s, [i for i, _ in train], k) for (t, _), s in zip(test, sims)}


def found(spark, train, test, k):
    got = {}
    for r in sorted(D.embedding_neighbors(vectors(spark, train), vectors(spark, test), k).collect(), key=lambda r: (r["test_id"], r["neighbor_rank"])):
        got.setdefault(r["test_id"], []).append((r["train_id"], r["similarity"]))
    return got


def same(got, expected):
    assert got.keys() == expected.keys()
    for t, best in expected.items():
        assert [s for _, s in got[t]] == pytest.approx([s for _, s in best], abs=1.1e-6)
        assert len({i for i, _ in got[t]}) == len(best)


@pytest.mark.parametrize("spread", [0.01, 3.0])
def test_balls_find_the_nearest_vectors(spark, spread):
    rows = list(enumerate(clustered(1, 900, spread=spread)))
    train, test = rows[:800], [*rows[800:], (5000, np.zeros(16))]
    train += [(10_000 + i, rows[0][1]) for i in range(400)] + [(20_000, np.zeros(16))]
    same(found(spark, train, test, 3), nearest(train, test, 3))


def test_copies_go_by_id(spark):
    train = [(i, [1.0, 2.0, 2.0]) for i in range(50)] + [(99, [-1.0, 0.0, 0.0])]
    assert found(spark, train, [(7, [2.0, 4.0, 4.0])], 3) == {7: [(0, 1.0), (1, 1.0), (2, 1.0)]}


def test_fewer_vectors_than_asked_for_and_null_ones(spark):
    train = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])]
    assert found(spark, train, [(1, [1.0, 0.0]), (2, None)], 5) == {1: [(1, 1.0), (3, 0.0)]}
    assert found(spark, [(2, None)], [(1, [1.0])], 2) == {} and found(spark, train, [(2, None)], 2) == {}


def test_balls_are_bounded_and_skipped(spark):
    rows = list(enumerate(clustered(2, 1200, spread=0.01))) + [(5000 + i, [1.0] + [0.0] * 15) for i in range(600)]
    units = N.unit_vectors(vectors(spark, rows), "vec_id", "train_id")
    centres = np.array([r["vec"] for r in units.orderBy(F.xxhash64("train_id"), "train_id").limit(40).collect()])
    balls = N.vector_balls(units, centres, block_rows=32)
    sizes = [r[0] for r in balls.select(F.size("ids")).collect()]
    assert max(sizes) <= 32 and sum(sizes) == 1800 and balls.select("block").distinct().count() == len(sizes)
    queries = units.filter("train_id < 60").withColumnRenamed("train_id", "test_id")
    assert N.reachable_blocks(queries, balls, centres, 1).count() < 0.35 * 60 * len(sizes)


def test_a_query_is_sent_to_a_shelf_of_blocks_once(spark):
    """The vectors that are dealt out do not grow with the number of blocks a query reaches."""
    rows = list(enumerate(clustered(4, 2000, spread=3.0)))
    units = N.unit_vectors(vectors(spark, rows), "vec_id", "train_id")
    centres = np.array([r["vec"] for r in units.orderBy("train_id").limit(4).collect()])
    balls, queries = N.vector_balls(units, centres, block_rows=16).persist(), units.filter("train_id < 20").withColumnRenamed("train_id", "test_id")
    reached = N.reachable_blocks(queries, balls, centres, 1)
    shelves = balls.select(F.expr(f"block div {N.SHELF}")).distinct().count()
    assert "vec" not in reached.columns and reached.count() > 3 * 20 * shelves
    best = N.ranked(N._nearest_in_blocks(reached, queries, balls, 1, 1), 1).collect()
    assert {r["test_id"]: r["train_id"] for r in best} == {i: i for i in range(20)}
    balls.unpersist()
