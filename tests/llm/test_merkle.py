import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from convosieve.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, key string, pos int, path int, salt int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels from the leaves to the single node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield "".join(level[first:at]), "".join(level[at + 1 : first + 8])
        at //= 8


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (name, levels) in enumerate(zip(names, trees)):
        for at, (_, _, own, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            path = [*steps(levels, at), *steps(top, k)]
            node, d = own, r["doc_id"]
            if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf(r, r["text"].translate({c: c + 32 for c in range(65, 91)}))
            for before, behind in path:
                node = H(before, node, behind)
            root = top[-1][0]
            out.append((d, own, levels[-1][0], root, H(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def found(spark, docs, tmp_path):
    folder = str(tmp_path / "in")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = queries.op13(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(params=[1, 3])
def levels(request, monkeypatch):
    """Also with blocks of eight leaves, so that groups need several passes."""
    monkeypatch.setattr(merkle, "LEVELS", request.param)
    monkeypatch.setattr(merkle, "BLOCK", 8**request.param)


def table(spark, sizes, text=lambda i: f"Text {i} É"):
    rows = [(i, "s" if i % 3 else None, lang, i % 7 or None, text(i)) for lang, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def test_sizes_around_the_fanout(spark, tmp_path, levels):
    docs = table(spark, {None: 1, "": 2, "a": 7, "b": 8, "c": 9, "é": 64, "z": 65, "=": 73, "Z": 3, "q": 1})
    assert found(spark, docs, tmp_path) == expected(docs.collect())


def test_one_lone_leaf_and_an_empty_table(spark, tmp_path):
    docs = table(spark, {"a": 1})
    got = found(spark, docs, tmp_path)
    assert got == expected(docs.collect()) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()
    assert found(spark, docs.where("false"), tmp_path / "empty") == []


def test_repeated_rows_null_ids_and_hot_groups(spark, tmp_path, levels):
    hot = spark.range(600).select(F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.lit("AB").alias("text"), F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    docs = hot.unionByName(table(spark, {"x": 20, None: 11}).select(hot.columns))
    assert found(spark, docs, tmp_path) == expected(docs.collect())


def test_awkward_texts(spark, awkward, tmp_path):
    assert found(spark, awkward, tmp_path) == expected(awkward.collect())


def test_more_groups_than_a_block_holds(spark, tmp_path):
    docs = spark.range(1300).selectExpr("id AS doc_id", "'s' AS source", "concat('l', id % 650) AS lang", "id AS n_chars", "'T' AS text")
    assert found(spark, docs, tmp_path) == expected(docs.collect())


def test_every_path_leads_to_the_root(spark, documents):
    rows = merkle.manifest(documents)
    fold = rows.select("root", "changed_leaf", merkle.folded(F.col("leaf"), F.col("path")).alias("folded"))
    assert rows.count() == documents.count() and fold.where("folded <> root OR changed_leaf IS NOT NULL").count() == 0
