"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: Positions of the ring, and parts into which the rows of one position are split for numbering.
POSITIONS, PARTS = 1 << 16, 8


def ring(spark: SparkSession, shards: int, vnodes: int, positions: int = POSITIONS) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; shards * vnodes rows."""
    nodes = spark.range(shards * vnodes).select(
        F.pmod(F.xxhash64(F.lit("virtual node"), F.expr(f"id div {vnodes}"), F.expr(f"id % {vnodes}")), F.lit(positions)).alias("p"),
        F.expr(f"cast(id div {vnodes} as int)").alias("s"),
    )
    return sorted((r.p, r.s) for r in nodes.collect())


def sweep(arcs: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Places the rows of each arc, given as (shard, rows) in ring order.

    A shard first takes the rows of its own arcs; what is too much for it goes on clockwise to the
    next virtual node whose shard has room, earliest overflow first. Returns (arc, from, to, shard,
    slot): rows from..to of the arc go to the shard, into slots from slot on. The capacities must
    hold all rows, so that two laps are enough. The work is bounded by shards x virtual nodes.
    """
    used, placed, rest = [0] * len(capacity), [], []

    def put(arc: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, capacity[shard] - used[shard])
        if n > 0:
            placed.append((arc, start, start + n, shard, used[shard]))
            used[shard] += n
        return start + max(n, 0)

    for arc, (shard, rows) in enumerate(arcs):
        rest.append(put(arc, 0, rows, shard))
    carried: deque[tuple[int, int, int]] = deque()
    for lap in range(2):
        for arc, (shard, rows) in enumerate(arcs):
            if lap == 0 and rest[arc] < rows:
                carried.append((arc, rest[arc], rows))
            while carried and used[shard] < capacity[shard]:
                a, start, end = carried.popleft()
                if (start := put(a, start, end, shard)) < end:
                    carried.appendleft((a, start, end))
    assert not carried, "capacities are smaller than the rows"
    return placed


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """slack 0: counts at most one apart; otherwise (1 + slack) times the mean for every shard."""
    if slack > 0:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """Shard and slot of every row: key, size, text_crc32, home_shard, shard, slot.

    Rows lie on the ring by the hash of their key. The load is the number of rows; with slack 0
    every shard is filled to exactly its share, so counts are at most one apart. A null key hashes
    like any other value, a null text is empty; repeated rows and keys each take a slot of their own.
    Other columns are left out. An empty table gives an empty result. Texts of any length are only measured, where they lie.
    Rows that repeat key, size and checksum, such as null keys with one text, are numbered by one task, which streams them.

    Only counts leave the executors: one per arc of the ring, shards * vnodes at most. Rows are numbered
    in two levels (position and part, then running sums over those), so no window spans a shard.
    """
    spark = df.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(whole) + 16).cast("bigint").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    ).withColumn("_cell", F.pmod(F.xxhash64("_key"), F.lit(POSITIONS)).cast("int"))
    rows = rows.withColumn("_part", F.pmod(F.hash("text_crc32", "size"), F.lit(PARTS)).cast("int"))

    nodes = ring(spark, shards, vnodes)
    at = [p for p, _ in nodes]
    # Of virtual nodes at one position the first gets the arc. Positions past the last one belong to the first.
    spans, start = [], 0
    for p in sorted(set(at)):
        spans.append((bisect_left(at, p), start, p))
        start = p + 1
    owner = [s for _, s in nodes]
    if start < POSITIONS:
        spans.append((0, start, POSITIONS - 1))
    cells = _inline(spark, "arc int, p0 int, p1 int", spans).select("arc", F.explode(F.sequence("p0", "p1")).alias("_cell"))

    counted = rows.groupBy("_cell", "_part").agg(F.count("*").alias("n")).join(F.broadcast(cells), "_cell")
    by_arc = {r.arc: r.n for r in counted.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    total = sum(by_arc.values())
    placed = sweep([(owner[a], by_arc.get(a, 0)) for a in range(len(nodes))], capacities(total, shards, slack))
    segments = _inline(spark, "arc int, r0 bigint, r1 bigint, shard int, slot0 bigint", placed)

    before = F.sum("n").over(W.partitionBy("arc").orderBy("_cell", "_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counted.select("_cell", "_part", "arc", F.coalesce(before, F.lit(0)).alias("before"))
    within = W.partitionBy("_cell", "_part").orderBy(F.xxhash64("_key"), "_key", "text_crc32", "size")
    numbered = rows.withColumn("_n", F.row_number().over(within) - 1).join(offsets, ["_cell", "_part"])
    ranked = numbered.withColumn("_rank", F.col("before") + F.col("_n"))
    homes = _inline(spark, "arc int, home_shard int", list(enumerate(owner)))
    return (
        ranked.join(F.broadcast(segments), (ranked["arc"] == segments["arc"]) & (F.col("_rank") >= F.col("r0")) & (F.col("_rank") < F.col("r1")))
        .drop(segments["arc"])
        .join(F.broadcast(homes), "arc")
        .select(F.col("_key").alias(key), "size", "text_crc32", "home_shard", "shard", (F.col("slot0") + F.col("_rank") - F.col("r0")).alias("slot"))
    )


def _inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of numbers as one JSON literal, so that it needs no RDD; bounded by the ring."""
    names = [f.split()[0] for f in schema.split(", ")]
    kind = f"array<struct<{', '.join(': '.join(f.split()) for f in schema.split(', '))}>>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
