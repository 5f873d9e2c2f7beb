"""Repeated passages by the sparsely retained suffixes of a suffix array over words, counted by hash instead of sorted.

A suffix is retained where the hash of the next K words is the least of a passage-long window: the choice depends on the words alone,
so every copy of a passage retains the same suffixes.  No suffix is sorted or compared with a neighbour: the
hashes of those K words are counted, and those met twice or more are kept.  For each, all passages of `length` words whose least
suffix it is are hashed whole and counted again: equal hashes are repeats, and all but the first (by id, then place) are later copies.  Overlapping passages
join into maximal spans.

`spans` gives a word that lies in a first and in a later passage to the first.  `cut` takes out every later passage whole, also where
it is nested in a longer one that is first seen there; of a later passage that overlaps its own first copy (in a periodic text) the part
behind that copy goes.  So no later passage stays, and each word that goes stands, at its place in the first copy, nearer to the
front of the corpus, where at last it is kept.  Passages that arise only where a cut joins two sides are not looked for again.

Equal keys are counted before the shuffle, so a passage in a third of all documents is one row per task there; in a sorted order it
would be one run for one task to compare.  Equal texts are one text with its copies.  No pair of occurrences is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, discard, free_name, pairs, sliced, stored, words
from convosieve.llm.hashing import Runs, hashed, word_hashes

#: Words by which suffixes are chosen and first compared.
K = 8


def _retained(text: str | None, length: int, memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash per passage, and per passage the place and hash of its least suffix."""
    found = words(text)
    if len(found) < length:
        none = np.zeros(0, np.uint64)
        return none, none.view(np.int64), none
    runs = Runs(hashed(found, memo))
    keys = runs.of(K)
    inside = np.lib.stride_tricks.sliding_window_view(keys, length - K + 1)
    place = np.arange(len(inside)) + inside.argmin(axis=1)
    return runs.of(length), place, keys[place]


def _suffixes(length: int):
    schema = arrow_schema("doc_id long, key long, n_words long, suffixes array<long>")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for own in sliced(batches):
            rows = []
            for doc_id, key, text in pairs(own, "doc_id", "key", "text"):
                _, place, keys = _retained(text, length, memo)
                once = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else slice(0)
                rows.append((doc_id, key, len(words(text)), keys[once].view(np.int64)))
            yield batch(rows, schema)

    return suffixes


def _passages(length: int):
    schema = arrow_schema("doc_id long, key long, starts array<int>, runs array<long>")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for own in sliced(batches):
            rows = []
            for doc_id, key, text, wanted in pairs(own, "doc_id", "key", "text", "wanted"):
                runs, _, keys = _retained(text, length, memo)
                starts = np.flatnonzero(np.isin(keys, np.array(wanted, np.int64).view(np.uint64)))
                rows.append((doc_id, key, starts.astype(np.int32), runs[starts].view(np.int64)))
            yield batch(rows, schema)

    return passages


def islands(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


SPANS = "key long, doc_id long, copies long, n_words long, firsts array<int>, first_ends array<int>, laters array<int>, later_ends array<int>, cuts array<int>, cut_ends array<int>"


def _join_spans(length: int):
    schema = arrow_schema(SPANS)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            rows = []
            for key, doc_id, copies, n, places, near in pairs(own, "key", "doc_id", "copies", "n_words", "places", "near"):
                first, later = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
                for place in places or ():
                    mark = later if place & 1 else first
                    mark[place >> 1] += 1
                    mark[(place >> 1) + length] -= 1
                cut = later.copy()
                for place in near or ():
                    cut[place // length] -= 1
                    cut[place // length + place % length] += 1
                first, later, cut = (np.cumsum(marks)[:-1] > 0 for marks in (first, later, cut))
                later &= ~first
                if copies > 1:
                    first = ~later
                rows.append((key, doc_id, copies, n, *(list(e) for s in (first, later, cut) for e in (zip(*islands(s)) if s.any() else ((), ())))))
            yield batch(rows, schema)

    return join


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def repeated_texts(docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words) of all rows, and SPANS of the distinct texts (key: their hash) with repeats; doc_id is their least id."""
    keyed = _keyed(docs)
    found = stored(keyed.mapInArrow(_suffixes(length), "doc_id long, key long, n_words long, suffixes array<long>"))
    rows = stored(found.drop("suffixes"))
    long = found.where(F.col("n_words") >= length).groupBy("key")
    texts = stored(long.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("suffixes").alias("suffixes")))
    discard(found)
    suffixes = texts.select("key", "doc_id", F.explode("suffixes").alias("suffix"))
    met = suffixes.groupBy("suffix").agg(F.count("*").alias("n")).where("n > 1").select("suffix")
    wanted = stored(suffixes.join(met, "suffix").groupBy("key", "doc_id").agg(F.collect_set("suffix").alias("wanted")))
    bodies = keyed.select("key", "text").join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    passages = wanted.join(bodies, "key").select("doc_id", "key", "text", "wanted")
    passages = stored(passages.mapInArrow(_passages(length), "doc_id long, key long, starts array<int>, runs array<long>"))
    discard(wanted)
    each = passages.select("doc_id", "key", F.explode(F.arrays_zip("starts", "runs")).alias("p")).select("doc_id", "key", "p.starts", "p.runs")
    first = each.groupBy("runs").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "starts")).alias("first")).where("n > 1")
    met = each.join(first, "runs")
    later = (F.col("key") != F.col("first.key")) | (F.col("starts") != F.col("first.starts"))
    # Words of a later passage that its own first copy reaches; with its start, of the few that have any.
    reached = F.col("first.starts") + length - F.col("starts")
    near = F.when(later & (F.col("key") == F.col("first.key")) & (reached > 0), F.col("starts").cast("long") * length + reached)
    places = met.groupBy("key").agg(F.collect_list(F.col("starts") * 2 + later.cast("int")).alias("places"), F.collect_list(near).alias("near"))
    found = texts.drop("suffixes").join(places, "key", "left").where("copies > 1 OR places IS NOT NULL")
    spans = stored(found.mapInArrow(_join_spans(length), SPANS))
    discard(texts, passages)
    return rows, spans


def spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), first_copy: the maximal spans of words that belong to passages of `length` words
    found twice or more, across documents or within one.  first_copy tells the span to keep from its later copies.

    Words are `[^\\x20\\x09-\\x0D]+`.  Null, empty and shorter texts have no spans.  Of rows with equal texts the one with the least id
    is the first copy (rows that also share the id are all first).  An empty table gives no rows.
    """
    rows, texts = repeated_texts(docs, length)
    ranges = lambda a, b, flag: F.transform(F.arrays_zip(a, b), lambda s: F.struct(s[a].alias("start_word"), s[b].alias("end_word"), F.lit(flag).alias("first_copy")))
    own = F.concat(ranges("firsts", "first_ends", True), ranges("laters", "later_ends", False))
    whole = F.array(F.struct(F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"), F.lit(False).alias("first_copy")))
    texts = texts.select("key", F.col("doc_id").alias("first_id"), "n_words", own.alias("own"))
    met = rows.drop("n_words").join(texts, "key")
    found = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")), F.col("own")).otherwise(whole)
    met = met.select("doc_id", F.explode(found).alias("s"))
    return met.select("doc_id", F.col("s.start_word").cast("long").alias("start_word"), F.col("s.end_word").cast("long").alias("end_word"), "s.first_copy")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without some spans of words and the white space after them."""
    body = text.encode()
    at = [m.start() for m in _WORD.finditer(body)] + [len(body)]
    kept, last = [], 0
    for a, b in zip(starts, ends):
        kept.append(body[last : at[a]])
        last = at[b]
    return b"".join([*kept, body[last:]]).decode()


def cut(docs: DataFrame, length: int = 50) -> DataFrame:
    """`docs` with the later copies of repeated passages cut out of `text`; a row of which no word is left goes.  n_chars, if there
    is such a column, follows the text; all other columns pass through, whatever their names.  Null, empty and short texts stay as they
    are, very long ones are cut whole.  Of equal texts the row with the least id stays (each row that also shares that id), the others go.
    An empty table stays empty."""
    _, texts = repeated_texts(docs, length)
    marks = [free_name(docs, c) for c in ("key", "first_id", "cuts", "cut_ends")]
    key, first_id, cuts, ends = marks
    texts = texts.select(F.col("key").alias(key), F.col("doc_id").alias(first_id), F.col("cuts").alias(cuts), F.col("cut_ends").alias(ends))
    met = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(texts, key, "left")
    copy = F.col(key).isNotNull() & F.col(cuts).isNotNull() & ~F.col("doc_id").cast("long").eqNullSafe(F.col(first_id))
    met = met.where(~copy).select(*docs.columns, F.when(F.size(cuts) > 0, F.col(cuts)).alias(cuts), F.col(ends).alias(ends))
    schema = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sliced(batches):
            names = own.schema.names[:-2]
            out, texts = own.select(names), []
            for text, a, b in zip(own.column("text").to_pylist(), own.column(-2).to_pylist(), own.column(-1).to_pylist()) if own.num_rows else ():
                texts.append(without_words(text, a, b) if a else text)
            cut = pa.array([bool(a) for a in own.column(len(names)).to_pylist()], pa.bool_())
            left = pa.array([not c or bool(words(t)) for c, t in zip(cut.to_pylist(), texts)], pa.bool_())
            columns = list(out.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([len(t) if c else n for t, c, n in zip(texts, cut.to_pylist(), columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(left)

    return met.mapInArrow(rewrite, schema)
