"""Exact n-gram Jaccard join through a token-group matrix.

A document is the set of its hashed word shingles; equal sets are one node.  Two filters and one index, all without loss:

* Each node probes with its first tokens by hash.  Where n tokens must share at least `percent` per cent with a partner's, the first
  (n less that share, plus `depth`) tokens of either side have at least `depth` in common; a node with fewer probes that any other
  node has too can link with nothing and goes.  That leaves few nodes, whose whole sets are read.
* Among these the number of nodes that have a token is exact.  Tokens go in the order of that number, rarest first, and only as many
  as can hold the first token in common with a partner are indexed.  A node's place of a token bounds what it can share from there
  on, so a pair (or a node and a group) meets at its first common token only where enough is left on both sides.
* Groups of similar nodes form first: nodes are compared with the most ordinary node (with the smallest share of tokens of its own)
  and the least node of their tokens, and what links is one group.  The matrix holds, per indexed token, the groups that have it with
  bounds over their members; groups below the bound stay closed, the members of the others are bounded the same way and then compared
  exactly.  Pairs within a group are never listed: they are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convosieve.llm.common import arrow_schema, batch, discard, free_name, lower_words, release, sliced, stored
from convosieve.llm.graphs import components
from convosieve.llm.hashing import Runs, hashed, word_hashes

#: A set of n tokens probes deep enough to have 1 + n / DEPTH in common with a partner's probes.
DEPTH = 10
#: Nodes that go leave others without the probes they shared, so the first filter is run so often.  Any number is right.
ROUNDS = 2
#: Passes over the tokens where those of one node are counted: the shuffle of all is the join's largest.
PASSES = 2
#: Up to so many text keys are broadcast (8 bytes each); more are joined by a shuffle of the texts.
KEYS = 1_000_000
SIGNATURES = "doc_id long, key long, n_shingles long, node long, probe array<long>"


def shingle_set(text: str | None, size: int, memo) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words are one shingle, none are the empty set."""
    words = lower_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(Runs(hashed(words, memo)).of(min(size, len(words))))


def _long_lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _sign(size: int, percent: int):
    schema = arrow_schema(SIGNATURES)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for own in sliced(batches):
            sizes, nodes, probe = [], [], []
            for text in own.column("text").to_pylist():
                found = shingle_set(text, size, memo)
                n = len(found)
                sizes.append(n)
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if n else None)
                probe.append(found[: n - -(-percent * n // 100) + 1 + n // DEPTH])
            columns = [own.column("doc_id"), own.column("key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _long_lists(probe)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return sign


def _sets(size: int):
    schema = arrow_schema("node long, tokens array<long>")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for own in sliced(batches):
            found = [shingle_set(t, size, memo) for t in own.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column("node"), _long_lists(found).cast(schema[1].type)], schema=schema)

    return sets


def _fits(a: str, b: str, percent: int):
    """Set sizes of which one is at least `percent` per cent of the other."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _alone(sets: DataFrame, tokens: str) -> DataFrame:
    """(node, alone): how many of a node's tokens no other node has.  Rows of one node may repeat; hot tokens combine before the shuffle.

    Each of PASSES passes shuffles its share of the tokens, and its shuffle goes before the next."""
    passes = []
    for k in range(PASSES):
        own = F.filter(tokens, lambda t: F.pmod(t, F.lit(PASSES)) == k)
        ends = sets.select("node", F.explode(own).alias("token")).groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last"))
        passes.append(stored(ends.where("node = last").groupBy("node").agg(F.count("*").alias("alone"))))
        release(sets.sparkSession)
    return reduce(DataFrame.unionByName, passes).groupBy("node").agg(F.sum("alone").alias("alone"))


def _bounded(keys: DataFrame) -> DataFrame:
    """Up to KEYS keys are broadcast, more are left to a shuffle."""
    return F.broadcast(keys) if keys.count() <= KEYS else keys


class Join:
    """The steps over one table: signatures, nodes, the nodes that may link, their sets and index, groups, candidates, links."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        signed = stored(docs.mapInArrow(_sign(size, percent), SIGNATURES))
        self.signatures = stored(signed.select("doc_id", "key", "n_shingles", "node", F.size("probe").alias("probes")))
        some = self.signatures.where("node IS NOT NULL").groupBy("node")
        first = [F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n_shingles").cast("int").alias("n"), F.first("probes").alias("probes")]
        self.nodes = stored(some.agg(*first))
        self.sets = self.whole_sets(self.likely(signed))
        self.index = self.rare_first()

    def likely(self, signed: DataFrame) -> DataFrame:
        """(node, key) of the nodes with enough probes that another such node has too; the signatures go."""
        smallest = F.ceil(self.percent * F.col("n") / 100)  # of a partner
        enough = F.least(smallest, 1 + F.floor(smallest / DEPTH))  # a set that probes with all its tokens has `smallest` in common
        rows, nodes, last = signed.where("node IS NOT NULL").select("node", "probe"), self.nodes, [signed]
        for left in reversed(range(ROUNDS)):
            shared = F.col("probes") - F.coalesce("alone", F.lit(0))
            fewer = stored(nodes.join(_alone(rows, "probe"), "node", "left").where(shared >= enough).select("node", "key", "n", "probes"))
            if left:
                rows = stored(rows.join(_bounded(fewer.select("node")), "node", "left_semi").groupBy("node").agg(F.first("probe").alias("probe")))
            discard(*last)
            nodes, last = fewer, [rows, fewer] if left else []
        return nodes.select("node", "key")

    def whole_sets(self, wanted: DataFrame) -> DataFrame:
        """The token sets of some nodes, from one text each, without nodes that have too many tokens of their own."""
        texts = self.docs.join(_bounded(wanted.select("key")), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        sets = stored(wanted.join(texts, "key").select("node", "text").mapInArrow(_sets(self.size), "node long, tokens array<long>"))
        shared = F.col("n") - F.coalesce("alone", F.lit(0))
        sizes = sets.select("node", F.size("tokens").alias("n")).join(_alone(sets, "tokens"), "node", "left")
        likely = stored(sizes.where(100 * shared >= self.percent * F.col("n")).select("node"))
        fewer = stored(sets.join(_bounded(likely), "node", "left_semi"))
        discard(sets, likely)
        return fewer

    def rare_first(self) -> DataFrame:
        """The index: token, node, n, own (tokens that no other node has), left (tokens from this one on), before (the token before).

        Tokens of one node come first in the order and never meet, so they are counted and left out.
        """
        each = self.sets.select("node", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        often = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        order = Window.partitionBy("node").orderBy("df", "token")
        rows = each.join(often, "token").select(
            "*", F.row_number().over(order).alias("place"), F.lag("token").over(order).alias("before"), F.count("*").over(Window.partitionBy("node")).alias("met")
        )
        rows = rows.withColumn("own", F.col("n") - F.col("met")).withColumn("left", F.col("met") - F.col("place") + 1)
        return stored(rows.where(100 * F.col("left") >= self.percent * F.col("n")).select("token", "node", "n", "own", "left", "before"))

    def reaches(self, left: str, other_left: str, n: str, m: str):
        """Sets of n and m tokens that share what is left on the scarcer side would be similar enough."""
        return (100 + self.percent) * F.least(left, other_left) >= self.percent * (F.col(n) + F.col(m))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough."""
        a, b = (self.sets.select(F.col("node").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
        met = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
        union = F.size("ta") + F.size("tb") - F.col("both")
        return met.where(100 * F.col("both") >= self.percent * union).select("a", "b")

    def group_links(self) -> DataFrame:
        """Links of nodes with the most ordinary and the least node of their tokens."""
        row = F.struct("node", "n", "left")
        ordinary = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), row.alias("row"))).alias("ordinary")
        leaders = self.index.groupBy("token").agg(ordinary, F.min(row).alias("least"), F.count("*").alias("df")).where("df > 1")
        leaders = leaders.select("token", F.explode(F.array_distinct(F.array("ordinary.row", "least"))).alias("b"))
        leaders = leaders.select("token", F.col("b.node").alias("b"), F.col("b.n").alias("m"), F.col("b.left").alias("other_left"))
        pairs = self.index.join(leaders, "token").where((F.col("node") != F.col("b")) & self.reaches("left", "other_left", "n", "m"))
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = stored(pairs)
        links = stored(self.linked(pairs))
        discard(pairs)
        return links

    def other_links(self, groups: DataFrame) -> DataFrame:
        """Links between nodes of different groups, given (node, component) of the grouped ones.

        A pair is met at its first common token: where both have the same token before this one, they have met there.
        """
        index = stored(self.index.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"))
        bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("left").alias("most_left"), F.min("before").alias("before_lo"), F.max("before").alias("before_hi")]
        matrix = index.groupBy("token", F.col("group").alias("other")).agg(*bounds, (F.count("before") < F.count("*")).alias("starts"))
        smallest = F.greatest(F.col("lo"), F.ceil(F.col("n") * self.percent / 100))
        fits = (100 * F.col("n") >= self.percent * F.col("lo")) & (100 * F.col("hi") >= self.percent * F.col("n"))
        enough = (100 + self.percent) * F.least("left", "most_left") >= self.percent * (F.col("n") + smallest)
        earlier = ~F.col("starts") & (F.col("before_lo") == F.col("before_hi")) & F.col("before").eqNullSafe(F.col("before_lo"))
        opened = index.join(matrix, "token").where((F.col("other") < F.col("group")) & fits & enough & ~earlier)
        opened = opened.select("token", "other", F.col("node").alias("a"), "n", "left", "before")
        members = index.select("token", F.col("group").alias("other"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("before").alias("other_before"))
        met = opened.join(members, ["token", "other"]).where(_fits("n", "m", self.percent) & self.reaches("left", "other_left", "n", "m"))
        met = met.where(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col("other_before")))
        pairs = stored(met.select("a", "b").distinct())
        links = stored(self.linked(pairs))
        discard(pairs, index, self.index, self.sets)
        return links

    def components(self) -> DataFrame:
        """(node, component) of the nodes with links."""
        links = self.group_links()
        groups = stored(components(links))
        return components(links.union(self.other_links(groups)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and node (which set it is) per row.

    Documents without words (null, empty, white space) have no node, link with nothing and are their own component.  Rows of
    equal texts share a node; null ids never name a component unless all of it are null.  An empty table gives no rows.
    """
    join = Join(_keyed(docs), size, percent)
    found = join.nodes.join(join.components(), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = found.join(names, "component").select("node", "component", "component_id")
    return join.signatures.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "component", "key"
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without all but one of each component (the least by id and text hash); rows without words (null, empty,
    white space) stay.  Of rows that share id and text but differ in other columns any one stays.  Other columns pass through, whatever
    their names.  An empty table stays empty."""
    found = stored(similar(docs, size, percent).where("node IS NOT NULL").select("doc_id", "key", "component"))
    copies = found.groupBy("doc_id", "key", "component").agg(F.count("*").alias("rows"))
    first = copies.groupBy("component").agg(F.min(F.struct("doc_id", "key", "rows")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"), F.col("first.rows").alias("_rows"))
    key, rows = free_name(docs, "key"), free_name(docs, "rows")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    first = first.select("_id", F.col("_key").alias(f"{key}_"), F.col("_rows").alias(rows))
    met = keyed.join(first, (keyed[key] == first[f"{key}_"]) & keyed["doc_id"].eqNullSafe(first["_id"]))
    met = met.select(*(keyed[c] for c in docs.columns), keyed[key], first[rows])
    once = met.where(F.col(rows) == 1).select(*docs.columns)
    again = met.where(F.col(rows) > 1).dropDuplicates(["doc_id", key]).select(*docs.columns)
    blank = docs.where(F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))
    return once.unionByName(again).unionByName(blank)
