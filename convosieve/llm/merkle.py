"""Merkle manifest of a dataset: one tree per group, a tree over the groups' roots, and the proof of every row.

A group's leaves are cut into aligned blocks of FANOUT ** LEVELS.  A block keeps each of its levels as one string of hex digests, so
a run of siblings is a substring of fixed width, its hash is a parent, and what flanks a node in its run is that node's share of the
proof.  The blocks' roots are the leaves of the next pass, until each group has one root; no task holds more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convosieve.llm.common import stored

FANOUT, LEVELS, HEX = 8, 3, 64
BLOCK = FANOUT**LEVELS
RUN = FANOUT * HEX
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one sorted part should have.
PART_ROWS = 500_000


def leaf_hash(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


def parents(level: str) -> str:
    """SQL of the next level's string: the hash of every run of FANOUT digests."""
    return f"array_join(transform(sequence(0, (length({level}) - 1) div {RUN}), r -> sha2(substring({level}, r * {RUN} + 1, {RUN}), 256)), '')"


def flanks(level: str, node: str) -> str:
    """SQL of what stands before and behind a node in its run."""
    first, at = f"({node}) div {FANOUT} * {RUN}", f"({node}) % {FANOUT}"
    before, behind = f"substring({level}, {first} + 1, {at} * {HEX})", f"substring({level}, {first} + ({at} + 1) * {HEX} + 1, ({FANOUT - 1} - {at}) * {HEX})"
    return f"struct({before} AS before, {behind} AS behind)"


def numbered(rows: DataFrame, group: str, order: list[str], *payload: str) -> DataFrame:
    """group, payload, `pos` (from 0 within the group, by `order`) and `size` (rows of the group).

    Rows are dealt out by ranges of (group, order), so a group of any size is sorted in parts; a part's start is the sum of the group's
    counts in the parts before it.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    dealt = stored(dealt.select(group, *payload, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size")
    )
    return dealt.join(starts, [group, "part"]).select(group, *payload, (F.col("at") + F.col("shift")).alias("pos"), "size")


def blocks(nodes: DataFrame, hash_column: str, *payload: str) -> DataFrame:
    """key, block, size, items (payload of the nodes in order), level strings s0.. and the block's root, of nodes (key, pos, size, hash)."""
    items = F.sort_array(F.collect_list(F.struct("pos", F.col(hash_column).alias("h"), *payload)))
    found = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("size").alias("size"), items.alias("items"))
    found = found.select(
        "key", "block", "size", F.array_join(F.transform("items", lambda x: x["h"]), "").alias("s0"),
        F.transform("items", lambda x: F.struct(x["pos"], *[x[c] for c in payload])).alias("items"),
    )
    for level in range(1, LEVELS + 1):
        found = found.withColumn(f"s{level}", F.expr(parents(f"s{level - 1}")))
    # A group that is one block ends with its first single node; blocks of larger groups climb all levels.
    depth = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        depth = F.when(F.col("size") <= FANOUT**level, level).otherwise(depth)
    root = F.element_at(F.array(*[f"s{level}" for level in range(LEVELS + 1)]), F.col("depth") + 1)
    return stored(found.withColumn("depth", depth).withColumn("root", root).drop(f"s{LEVELS}"))


def with_paths(found: DataFrame, above: DataFrame, *payload: str) -> DataFrame:
    """key, pos, payload, h, the columns of `above` (key, block, path, ...) and `path`: the flanks from each node up to the root.

    The blocks are opened in two steps, into runs, whose nodes share all but the first flanks, and then into nodes.
    """
    rest = [c for c in above.columns if c not in ("key", "block", "path")]
    steps = ", ".join(flanks(f"s{level}", f"cast(r div {FANOUT ** (level - 1)} AS int)") for level in range(1, LEVELS))
    run = f"struct(substring(s0, r * {RUN} + 1, {RUN}) AS run, slice(items, r * {FANOUT} + 1, {FANOUT}) AS own, concat(slice(array({steps}), 1, greatest(depth - 1, 0)), path) AS upper)"
    runs = found.drop("size", "root").join(above, ["key", "block"])
    runs = runs.select("key", "depth", *rest, F.expr(f"inline(transform(sequence(0, (size(items) - 1) div {FANOUT}), r -> {run}))"))
    names = ", ".join(f"own[w].{c} AS {c}" for c in ("pos", *payload))
    node = f"struct({names}, substring(run, w * {HEX} + 1, {HEX}) AS h, {flanks('run', 'w')} AS step)"
    nodes = runs.select("key", "depth", *rest, "upper", F.expr(f"inline(transform(sequence(0, size(own) - 1), w -> {node}))"))
    path = F.expr("if(depth > 0, concat(array(step), upper), upper)")
    return nodes.select("key", "pos", *payload, "h", *rest, path.alias("path"))


def tree(nodes: DataFrame, hash_column: str, *payload: str) -> list[DataFrame]:
    """The blocks of every pass over nodes (key, pos, size, hash); the last pass has one block, with the root, per key."""
    passes = [blocks(nodes, hash_column, *payload)]
    most = passes[0].agg(F.max("size")).first()[0] or 0
    while most > BLOCK:
        last = passes[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), "root")
        passes.append(blocks(last, "root"))
        most = -(-most // BLOCK)
    return passes


def proofs(passes: list[DataFrame], above: DataFrame, *payload: str) -> DataFrame:
    """`with_paths` of the nodes of the first pass, going down from `above` (key, path, ...) of the roots."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for found in reversed(passes[1:]):
        above = with_paths(found, above).drop("h").withColumnRenamed("pos", "block")
    return with_paths(passes[0], above, *payload)


def manifest(docs: DataFrame, id_column: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """id, leaf, changed_leaf, subroot, root and path (before, behind of each level, from the leaf's run to the root) of every row.

    `changed` replaces fields where `where` holds: changed_leaf is the leaf of such a row, null elsewhere.  A group's leaves ascend by
    id, nulls first, rows of one id by their hash; equal rows are leaves of their own.  The groups' roots ascend by the group's UTF-8
    bytes, null first.  Null and empty fields hash differently; texts of any length are hashed whole.  An empty table gives no rows.
    Only id, group and fields are read, and other columns may have any name.
    """
    plain = [F.col(c) for c in fields]
    touched = leaf_hash([(changed or {}).get(c, F.col(c)) for c in fields])
    leaves = stored(
        docs.select(
            # '' < '=...' keeps the order, and makes the null group one that joins.
            F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"), F.col(id_column).alias("id"), leaf_hash(plain).alias("leaf"),
            F.when(where, touched).alias("changed_leaf") if where is not None else F.lit(None).cast("string").alias("changed_leaf"),
            F.xxhash64(F.monotonically_increasing_id()).alias("salt"),  # deals out equal rows; stored, so a lost task finds the same
        )
    )
    nodes = numbered(leaves, "key", ["id", "leaf", "salt"], "id", "leaf", "changed_leaf")
    passes = tree(nodes, "leaf", "id", "changed_leaf")
    groups = passes[-1].select(F.lit("").alias("all"), F.col("key").alias("group_key"), F.col("root").alias("subroot"))
    tops = numbered(groups, "all", ["group_key"], "group_key", "subroot").withColumnRenamed("all", "key")
    upper = tree(tops, "subroot", "group_key")
    start = upper[-1].select("key", "root", F.array().cast("array<struct<before:string,behind:string>>").alias("path"))
    above = stored(proofs(upper, start, "group_key").select(F.col("group_key").alias("key"), F.col("h").alias("subroot"), "root", "path"))
    rows = proofs(passes, above, "id", "changed_leaf")
    return rows.select(F.col("id").alias(id_column), F.col("h").alias("leaf"), "changed_leaf", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["behind"]), 256))


def siblings_hash(path: Column) -> Column:
    """Hash of all siblings on the path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["behind"])), ""), 256)
