"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** ring_bits`` positions. Every shard owns ``vnodes`` points, a key hashes
to a position and belongs to the first point clockwise. A shard takes no more rows than its
capacity; what overflows goes on clockwise to the next point of a shard with room. All keys
of one position walk the same way, so the walk needs only the rows per position: a table of
fixed size (65,536 counts by default) that the driver walks once. Rows then find their shard
by their rank within their position, in one shuffle of narrow rows.

With ``slack=0`` the capacities add up to the rows exactly, so all shards fill and their row
counts differ by one at most. A new shard takes over the arcs of its own points; other rows
move only where the smaller capacities push them on (``moved`` in the tests).

Edge cases: rows with a null key are placed by the hash of the ``ties`` columns; equal keys
share a position and are ranked by the ties; rows equal in all of these are interchangeable;
an empty table gives no rows; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VNODES = 128
RING_BITS = 16
#: Rows of a position that one task ranks; a fuller position is cut by ranges of the hash.
LARGE = 1 << 20


def points(shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    """(position, shard) around the ring; the points of a shard do not depend on the number of shards."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8]) >> (64 - ring_bits)
    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [int(-(-(1 + slack) * rows // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> dict[int, list[tuple[int, int, int, int]]]:
    """{position: [(first rank, end rank, shard, first slot), ...]} for the rows per position."""
    ring = points(shards, vnodes, ring_bits)
    where = [p for p, _ in ring]
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    placed: dict[int, list[tuple[int, int, int, int]]] = {p: [] for p in counts}
    # In every round the open rows knock at one point each, in ring order.
    open_rows = [(p, 0, counts[p], bisect_left(where, p)) for p in sorted(counts)]
    while open_rows:
        left = []
        for position, first, end, at in open_rows:
            shard = ring[at % len(ring)][1]
            take = min(end - first, room[shard] - used[shard])
            if take:
                placed[position].append((first, first + take, shard, used[shard]))
                used[shard] += take
            if first + take < end:
                left.append((position, first + take, end, at + 1))
        # Full shards are passed by at once.
        open_rows = []
        for position, first, end, at in left:
            while room[shard := ring[at % len(ring)][1]] == used[shard]:
                at += 1
            open_rows.append((position, first, end, at))
    return placed


def _hash(key: str, ties: list[str]) -> Column:
    return F.when(F.col(key).isNull(), F.xxhash64(*ties) if ties else F.lit(0).cast("long")).otherwise(F.xxhash64(key))


def place(rows: DataFrame, key: str, shards: int, ties: tuple[str, ...] = (), slack: float = 0.0, vnodes: int = VNODES, ring_bits: int = RING_BITS) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard).

    ``rows`` is read twice: pass a written or checkpointed table of narrow rows. ``ties`` are
    columns that rank rows of one position and place rows without a key.
    """
    spark = rows.sparkSession
    mine = [c for c in rows.columns if c not in ("shard", "slot")]
    hashed = rows.select(*(F.col(f"`{c}`") for c in mine), _hash(key, list(ties)).alias("__llm_hash"))
    position = F.shiftrightunsigned("__llm_hash", 64 - ring_bits).cast("int")
    hashed = hashed.withColumn("__llm_at", position)
    counts = {r[0]: r[1] for r in hashed.groupBy("__llm_at").count().collect()}
    walked = walk(counts, shards, slack, vnodes, ring_bits)
    table = [(p, -(-counts[p] // LARGE), steps) for p, steps in walked.items()]
    kind = "__llm_at int, __llm_parts long, __llm_steps array<struct<first:long,end:long,shard:int,slot:long>>"
    # At most one row per position of the ring: 65,536 small ones by default, whatever the input.
    guide = F.broadcast(spark.createDataFrame(table, kind))
    joined = hashed.join(guide, "__llm_at")
    # A fuller position is cut into ranges of the hash, so the order of its rows is the same however many there are.
    beyond = F.shiftrightunsigned(F.shiftleft("__llm_hash", ring_bits), 33)
    joined = joined.withColumn("__llm_sub", F.shiftright(beyond * F.col("__llm_parts"), 31))
    group = ["__llm_at", "__llm_sub"]
    ranked = joined.withColumn("__llm_rank", F.row_number().over(Window.partitionBy(*group).orderBy("__llm_hash", key, *ties)).cast("long") - 1)
    if any(n > LARGE for n in counts.values()):
        sizes = joined.where("__llm_parts > 1").groupBy(*group).count()
        earlier = Window.partitionBy("__llm_at").orderBy("__llm_sub").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.select(*group, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__llm_before"))
        ranked = ranked.join(offsets, group, "left").withColumn("__llm_rank", F.col("__llm_rank") + F.coalesce("__llm_before", F.lit(0)))
    step = F.filter("__llm_steps", lambda s: (s["first"] <= F.col("__llm_rank")) & (F.col("__llm_rank") < s["end"]))[0]
    found = ranked.withColumn("__llm_step", step)
    slot = F.col("__llm_step.slot") + F.col("__llm_rank") - F.col("__llm_step.first")
    return found.select(*(F.col(f"`{c}`") for c in mine), F.col("__llm_step.shard").alias("shard"), slot.alias("slot"))
