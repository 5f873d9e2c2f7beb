import hashlib
import re
from collections import defaultdict

import pytest
from conftest import texts_of

from convosieve.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(rows, items):
    runs = defaultdict(set)
    for item, text in items:
        w = split(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            runs[tuple(w[i : i + k])].add(str(item))
    for doc_id, text in rows:
        w, hit, met = split(text), set(), set()
        for k in {len(r) for r in runs}:
            for i in range(len(w) - k + 1):
                if own := runs.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    met |= own
        yield doc_id, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def key(r):
    return repr(tuple(r))


@pytest.mark.parametrize("name", ["awkward", "documents", "empty"])
def test_against_brute_force(request, spark, data, name, monkeypatch):
    docs = request.getfixturevalue(name)
    bench = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "Word word"), (901, "größer THAN"), (902, None), (903, "?!"), (904, "x²5"), (None, "double spaces")], "item_id long, text string")
    bench = bench.union(extra)
    items = [(r["item_id"], r["text"]) for r in bench.collect() if r["item_id"] is not None]
    expected = sorted(map(key, brute(texts_of(docs), items)))
    assert sorted(map(key, contamination.report(docs, bench).collect())) == expected
    kept = contamination.clean(docs, bench)
    assert kept.schema == docs.schema and kept.count() == sum("True" not in e for e in expected)
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 300)  # several blocks
    assert sorted(map(key, contamination.report(docs, bench).collect())) == expected


def test_blocks_of_repeated_and_long_items(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(12000))
    items = [(1, long), *[(2, " ".join(f"v{i}" for i in range(40)))] * 300, (3, "short item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, " ".join(f"w{i}" for i in range(k * 97, k * 97 + 13 + k % 3))) for k in range(41)] + [(50, "a short item v3 v4"), (51, " ".join(f"v{i}" for i in range(20)))]
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 3000)
    sizes = [sum(len(b" ".join(words)) for _, words in block) for block in contamination.pattern_blocks(bench)]
    assert len(sizes) > 1 and max(sizes) < 2 * 5 * contamination.BLOCK_WORDS
    got = sorted(map(key, contamination.report(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()))
    assert got == sorted(map(key, brute(rows, items)))


def test_no_benchmark(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.report(awkward, none).where("n_hit > 0 OR contaminated").count() == 0
