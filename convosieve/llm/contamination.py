"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a run of words of a benchmark item: `window` consecutive ones, or the whole item if it is shorter.  For patterns of one
length, the shift table of word pairs says how far the search may jump; where it says 0, the bucket of the last pair's hash gives the
patterns to compare word by word.  The patterns are broadcast in blocks of about BLOCK_WORDS words: repeated items are dropped and long
ones cut into parts of a hundredth of a block, which overlap so that no pattern is lost, before the parts are dealt by hash.  The
documents pass block after block without a shuffle; a task has the tables of all blocks open.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, free_name, pairs, sliced, stored

BLOCK_WORDS = 2_000_000
#: A-Z become lower case; ASCII other than digits and letters becomes a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z."""
    return text.encode().translate(_TABLE).split() if text else []


class Patterns:
    """The patterns of one length: `shift` by pair of words, `buckets` of (pattern, items) by the hash of the last pair."""

    def __init__(self, length: int, found: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[int, list[tuple[tuple[bytes, ...], set[str]]]] = defaultdict(list)
        for pattern, items in found.items():
            for end in range(self.block, length + 1):
                pair = pattern[end - self.block : end]
                self.shift[pair] = min(self.shift.get(pair, self.jump), length - end)
            self.buckets[hash(pattern[length - self.block :])].append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(end, items) of every occurrence."""
        end, n, shift, block, jump = self.length, len(words), self.shift.get, self.block, self.jump
        while end <= n:
            pair = (words[end - 2], words[end - 1]) if block == 2 else (words[end - 1],)
            if step := shift(pair, jump):
                end += step
                continue
            run = tuple(words[end - self.length : end])
            for pattern, items in self.buckets.get(hash(pair), ()):
                if pattern == run:
                    yield end, items
            end += 1


def tables(items: list[tuple[str, list[bytes]]], window: int = 13) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, words in items:
        length = min(window, len(words))
        for i in range(len(words) - length + 1 if length else 0):
            by_length[length][tuple(words[i : i + length])].add(item)
    return [Patterns(n, found) for n, found in sorted(by_length.items())]


def _scan(block, window: int):
    spans_of, items_of = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = tables(block.value, window)
        for own in sliced(batches):
            hits, found = [], []
            for text, old_hits, old_items in pairs(own, "text", *own.schema.names[-2:]):
                words, spans, items = item_words(text), old_hits, set(old_items)
                for s in searches:
                    for end, met in s.search(words):
                        if spans and spans[-1][1] >= end - s.length >= spans[-1][0]:
                            spans[-1] = [spans[-1][0], max(end, spans[-1][1])]
                        else:
                            spans.append([end - s.length, end])
                        items |= met
                hits.append(spans)
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays([*own.columns[:-2], pa.array(hits, spans_of), pa.array(found, items_of)], names=own.schema.names)

    return scan


def _parts(window: int, step: int):
    """The items as parts that start every `step` words and overlap by `window` - 1."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PARTS)
        for own in sliced(batches):
            rows = []
            for item, text in pairs(own, "item", "text"):
                words = item_words(text)
                for i in range(0, max(1, len(words) - window + 1) if words else 0, step):
                    rows.append((item, b" ".join(words[i : i + step + window - 1]).decode()))
            yield batch(rows, schema)

    return parts


PARTS = "item string, part string"


def pattern_blocks(benchmark: DataFrame, window: int = 13) -> Iterator[list[tuple[str, list[bytes]]]]:
    """(item, words) of the parts of the items, block by block."""
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    parts = stored(items.mapInArrow(_parts(window, max(20 * window, BLOCK_WORDS // 100)), PARTS).distinct())
    size = parts.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    blocks = max(1, -(-size // (5 * BLOCK_WORDS)))
    for b in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == b).collect()
        yield [(r["item"], r["part"].encode().split()) for r in rows]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """`docs` with two more columns at the end: word spans covered by occurrences (they may overlap) and the items met.

    Null and empty texts have no words and no hits; an item without words has no pattern; items of a null id take no part.  An empty
    benchmark leaves every document without hits.  All other columns pass through.
    """
    out = docs.withColumns({free_name(docs, "hits"): F.array().cast("array<array<int>>"), free_name(docs, "items"): F.array().cast("array<string>")})
    for own in pattern_blocks(benchmark, window):
        block = docs.sparkSession.sparkContext.broadcast(own)
        out = out.mapInArrow(_scan(block, window), out.schema)
    return out


def _hit_words(spans) -> int:
    total, until = 0, 0
    for a, b in sorted(map(tuple, spans)):
        total += max(0, b - max(a, until))
        until = max(until, b)
    return total


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def _report(schema: pa.Schema):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sliced(batches):
            rows = []
            for doc_id, text, hits, items in pairs(own, "doc_id", "text", "hits", "items"):
                n, hit, names = len(item_words(text)), _hit_words(hits), ",".join(sorted(items))
                rows.append((doc_id, n, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), _contaminated(n, hit)))
            yield batch(rows, schema)

    return report


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hits on a twentieth of the words or more) per document.

    Null and empty texts have no words and are not contaminated; very long ones are scanned whole.  A null doc_id stays null, repeated
    rows each have a row, an empty table gives none.  Other columns are not read and may have any name.  Items without words match
    nothing, equal items of one id count once; with an empty benchmark nothing is hit.
    """
    return scan(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window).mapInArrow(_report(arrow_schema(REPORT)), REPORT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns, whatever their names; cases as in `report`, and repeated
    rows all stay or all go."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in sliced(batches):
            fine = [not _contaminated(len(item_words(text)), _hit_words(hits)) for text, hits in pairs(own, "text", own.schema.names[-2])]
            yield pa.RecordBatch.from_arrays(own.columns[:-2], names=own.schema.names[:-2]).filter(pa.array(fine, pa.bool_()))

    return scan(docs, benchmark, window).mapInArrow(keep, docs.schema)
