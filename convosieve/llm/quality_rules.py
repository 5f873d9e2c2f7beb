"""Quality rules by distribution divergence.

Per language, the corpus gives two references: the histogram of character classes and that of its common words (those with at least
`COMMON_SHARE` of the language's words, and one bin for all others).  A document is rejected when its Jensen-Shannon distance to every
language's reference is above a threshold, for its characters or for its words.  Documents too short to have a histogram of their own
are not judged by it.

All documents count for the references, and every language with a text has one, however rare it is; a language without a word has
only the histogram of classes.  A document without a language may be of one that has no reference, so its distances are reported
but do not reject it.  References are broadcast in blocks of about LANGUAGES languages of at most 1 / COMMON_SHARE words each, and a
task opens one block at a time.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, pairs, sliced, stored
from convosieve.llm.contamination import item_words
from convosieve.llm.hashing import word_hashes
from convosieve.llm.profiles import CLASSES, Profile, class_counts

COMMON_SHARE = 0.004
#: Distances (0 to 1) above which a document is unlike any language, and lengths below which it is not judged.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.30, 100
#: Words that a task counts before it hands its counts on.
FLUSH = 300_000
#: Languages whose references are open at once.
LANGUAGES = 1000
COUNTS = "lang string, kind string, item string, n long"


def _count(schema: pa.Schema):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        common: dict[str, Counter] = {}

        def flush():
            rows = [(lang, "word", w.decode(), n) for lang, own in common.items() for w, n in own.items()]
            rows += [(lang, "class", name, int(n)) for lang, own in classes.items() for name, n in zip(CLASSES, own)]
            common.clear()
            classes.clear()
            return batch(rows, schema)

        for own in sliced(batches):
            for lang, text in pairs(own, "lang", "text"):
                if text:
                    classes[lang] = classes.get(lang, 0) + class_counts(text.encode())
                    common.setdefault(lang, Counter()).update(item_words(text))
            if sum(map(len, common.values())) + len(CLASSES) * len(classes) > FLUSH:
                yield flush()
        yield flush()

    return count


@dataclass
class References:
    """Per language: shares of the classes, the common words' places and shares (others last)."""

    classes: np.ndarray
    words: list[tuple[dict[bytes, int], np.ndarray]]


def _common(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, kind, item, n, total: the classes and common words of every language; and the number of languages."""
    rows = docs.where("lang IS NOT NULL").select("lang", "text").mapInArrow(_count(arrow_schema(COUNTS)), COUNTS)
    counts = stored(rows.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))
    totals = stored(counts.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "word", F.col("n")).otherwise(0)).alias("total")))
    languages = totals.count()
    met = counts.join(F.broadcast(totals) if languages <= 100_000 else totals, "lang")
    return met.where((F.col("kind") == "class") | (F.col("n") >= COMMON_SHARE * F.col("total"))), languages


def _gathered(met: DataFrame) -> References:
    found: dict[str, dict] = {}
    for r in met.orderBy("lang", "kind", "item").collect():
        own = found.setdefault(r["lang"], {"total": r["total"], "class": {}, "word": {}})
        own[r["kind"]][r["item"]] = r["n"]
    classes = np.array([[own["class"].get(c, 0) for c in CLASSES] for own in found.values()], float).reshape(-1, len(CLASSES))
    classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
    common = []
    for own in found.values():
        if own["total"]:
            n = np.array([*own["word"].values(), own["total"] - sum(own["word"].values())], float)
            common.append(({w.encode(): i for i, w in enumerate(own["word"])}, n / n.sum()))
    return References(classes, common)


def references(docs: DataFrame) -> References:
    """Of all languages at once."""
    return _gathered(_common(docs)[0])


def _shared(docs: DataFrame) -> list:
    """Broadcasts of the pickled references, each of about LANGUAGES languages."""
    met, languages = _common(docs)
    blocks = -(-languages // LANGUAGES)
    if blocks > 1:
        met = stored(met)
    block = lambda b: met.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b)
    return [docs.sparkSession.sparkContext.broadcast(pickle.dumps(vars(_gathered(block(b))))) for b in range(blocks)]


def _opened(shared: list):
    """The blocks of references, to be gone through again and again; a single one stays open."""

    class Blocks:
        def __iter__(self):
            return (References(**pickle.loads(b.value)) for b in shared)

    return list(Blocks()) if len(shared) == 1 else Blocks()


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence to base 2, along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(part.sum(axis=-1) / 2, 0))


def distances(body: bytes, classes: np.ndarray, known: References) -> tuple[float | None, float | None]:
    """To the nearest reference, by characters and by words; None where the text is too short or there is no reference."""
    by_class = by_word = None
    total = int(classes.sum())
    if total >= MIN_CHARS and len(known.classes):
        by_class = float(js_distance(classes / total, known.classes).min())
    found = item_words(body.decode())
    if len(found) >= MIN_WORDS and known.words:
        counts, n = Counter(found), len(found)
        nearest = []
        for places, shares in known.words:
            own = np.array([counts[w] for w in places] + [0], float)
            own[-1] = n - own.sum()
            nearest.append(js_distance(own / n, shares))
        by_word = float(min(nearest))
    return by_class, by_word


def nearest(texts: list[tuple[bytes, np.ndarray]], blocks) -> list[tuple[float | None, float | None]]:
    """`distances` of (body, classes) over all blocks of references."""
    found: list[tuple[float | None, float | None]] = [(None, None)] * len(texts)
    for known in blocks:
        for i, (body, classes) in enumerate(texts):
            found[i] = tuple(min((x for x in both if x is not None), default=None) for both in zip(found[i], distances(body, classes, known)))
    return found


def kept(base_failed: bool, lang: str | None, by_class: float | None, by_word: float | None) -> bool:
    like = (by_class or 0) <= MAX_CLASS_DISTANCE and (by_word or 0) <= MAX_WORD_DISTANCE
    return not base_failed and (lang is None or like)


REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def report(docs: DataFrame) -> DataFrame:
    """REPORT of every whole text.  Null and empty texts have no words and fail; rows with a null language count for no reference and
    are judged by the base rules alone.  An empty table gives no rows."""
    shared, schema = _shared(docs), arrow_schema(REPORT)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, blocks = word_hashes(), _opened(shared)
        for own in sliced(batches):
            rows, texts = [], []
            for doc_id, lang, text in pairs(own, "doc_id", "lang", "text"):
                p = Profile(text, memo)
                rows.append((lang, (doc_id, p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed)))
                texts.append((p.body, p.classes))
            yield batch([(*row, kept(row[-1], lang, *far), *far) for (lang, row), far in zip(rows, nearest(texts, blocks))], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(judge, REPORT)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns, whatever their names.  Null and empty texts go, very long ones are
    judged whole, a null language is judged by the base rules alone; repeated rows all stay or all go; an empty table stays empty."""
    shared = _shared(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, blocks = word_hashes(), _opened(shared)
        for own in sliced(batches):
            profiles = [(p.base_failed, (p.body, p.classes)) for p in (Profile(t, memo) for t in own.column("text").to_pylist())]
            far = nearest([p[1] for p in profiles], blocks)
            fine = [kept(failed, lang, *d) for (failed, _), lang, d in zip(profiles, own.column("lang").to_pylist(), far)]
            yield own.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
