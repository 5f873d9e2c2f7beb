"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `virtual_nodes` arcs of a ring.  A row falls on an arc by the hash of its id, size and checksum and goes to the shard
that owns the arc; once that shard holds its bounded load, the row continues clockwise to the next arc whose shard has room.

The ring has a fixed number of cells, so the driver handles one count per cell and never a row.  Equal rows are counted before the
shuffle and unrolled at the end, so a key that holds a third of the table is one row in between.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def ring(shards: int, virtual_nodes: int = 64, cells: int = CELLS) -> list[int]:
    """The shard that owns each cell.  A virtual node stands on the cell of its hash (the next free one if taken) and owns
    the cells back to the node before it.  The nodes of a shard do not depend on how many shards there are."""
    if not 0 < shards * virtual_nodes <= cells:
        raise ValueError("the ring needs at least one cell per virtual node")
    stands: dict[int, int] = {}
    for v in range(virtual_nodes):
        for s in range(shards):
            at = int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") % cells
            while at in stands:
                at = (at + 1) % cells
            stands[at] = s
    owner, last = [0] * cells, stands[min(stands)]
    for cell in reversed(range(cells)):
        last = stands.get(cell, last)
        owner[cell] = last
    return owner


def bounded_loads(counts: dict[int, int], owner: list[int], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first): rows arrive in ring order, each goes to the first shard clockwise
    that has room.  With `slack` 0 every load is the mean, rounded up or down; otherwise it is at most (1 + slack) times the mean."""
    total, cells = sum(counts.values()), len(owner)
    if slack:
        room = [math.ceil(total / shards * (1 + slack))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    load, moves = [0] * shards, []
    for cell in sorted(counts):
        first, left, at = 0, counts[cell], cell
        while left:
            shard = owner[at]
            if take := min(left, room[shard] - load[shard]):
                moves.append((cell, first, first + take, shard, load[shard]))
                load[shard] += take
                first, left = first + take, left - take
            at = (at + 1) % cells
    return moves


def assign(docs: DataFrame, shards: int = 8, virtual_nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.

    Nulls: a null text is empty (size 1, crc 0); a null id is hashed with its row's checksum.  Equal rows take neighbouring ranks.
    An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    place = F.xxhash64("doc_id", "size", "text_crc32")
    kinds = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("place", place).withColumn("cell", F.pmod("place", F.lit(CELLS)).cast("int"))
    counts = {r["cell"]: r["n"] for r in kinds.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    moves = bounded_loads(counts, ring(shards, virtual_nodes), shards, slack)
    moves = spark.createDataFrame(moves, "cell int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "size", "text_crc32")
    ranked = kinds.withColumn("until", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("since", F.col("until") - F.col("n"))
    # At most CELLS + shards rows to broadcast, however large the table.
    met = ranked.join(F.broadcast(moves), "cell").where((F.col("lo") < F.col("until")) & (F.col("hi") > F.col("since")))
    ranks = F.sequence(F.greatest("lo", "since"), F.least("hi", "until") - 1)
    met = met.select("doc_id", "size", "text_crc32", "shard", "lo", "base", F.explode(ranks).alias("rank"))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
