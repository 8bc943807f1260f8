"""Shared helpers: written intermediate tables, connected components, Bloom filters and joins behind them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII characters that separate words everywhere in this subpackage.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset the warehouse, or in local mode,
    where all run in one process on one machine, a temporary folder."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.nodewell.shared.dir", None)
    if known is None:
        local = spark.sparkContext.master.split("[")[0] == "local"
        known = tempfile.mkdtemp(prefix="nodewell-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.nodewell.shared.dir", known)
    return known.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """name, longer where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nodewell/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    edges: columns a, b of one orderable type; direction, loops and repeats don't matter.
    Alternates large-star and small-star steps; each round is an aggregation and a join on the
    edge list, written to the shared folder, so that no neighbourhood is ever gathered in one task.
    """
    pairs = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges"
    )
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.toDF("u", "v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("u"), F.col("m"))).where("a <> b").distinct()
        pairs = materialise(small, "cc-round")
        # Stars only: every node hangs on one root, and no root hangs on another.
        n, sources = pairs.agg(F.count("*"), F.count_distinct("a")).first()
        rooted = pairs.select("b").distinct().join(pairs.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty()
        if n == sources and rooted and before == n:
            break
        before = n
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


WORDS, PROBES = 8, 6  # 64-bit words of a Bloom block, and bits set in it per member


def _probe(on: list[str], blocks: int) -> tuple[Column, Column]:
    """(block, array of bit numbers 0..511 in it) of the columns on."""
    bits = F.array(*[F.pmod(F.xxhash64(*on, F.lit(i)), F.lit(64 * WORDS)).cast("int") for i in range(PROBES)])
    return F.pmod(F.xxhash64(*on), F.lit(blocks)).cast("int"), bits


def possible_members(df: DataFrame, members: DataFrame, on: list[str], name: str, max_mb: int = 8, bits_each: int = 12) -> DataFrame:
    """df with a boolean column `name`: false only where members has no row with the same columns on.

    A blocked Bloom filter: one 512-bit block per member, as many blocks as the members need but max_mb at most, so its
    broadcast is bounded by construction. More members than that only let more rows pass.
    """
    blocks = max(1, min(max_mb * 2**20 // (8 * WORDS), -(-members.count() * bits_each // (64 * WORDS))))
    block, bits = _probe(on, blocks)
    single = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % 64)
    each = members.select(block.alias("_nw_b"), F.explode(bits).alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("bit").between(64 * w, 64 * w + 63), single)), F.lit(0)) for w in range(WORDS)]
    table = each.groupBy("_nw_b").agg(F.array(*words).alias("_nw_w"))
    b, own, w = (fresh(df, c) for c in ("_nw_b", "_nw_bits", "_nw_w"))
    is_set = lambda i: F.call_function("shiftright", F.get(F.col(w), F.floor(i / 64).cast("int")), i % 64).bitwiseAND(F.lit(1)) == 1
    probed = df.withColumns({b: block, own: bits}).join(F.broadcast(table.toDF(b, w)), b, "left")
    return probed.select(*df.columns, F.coalesce(F.forall(own, is_set), F.lit(False)).alias(name))


def join_few(big: DataFrame, few: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """big joined (left, inner or left_anti) with few, a written table of which most rows of big have no partner: only the
    rows that a Bloom filter passes are shuffled, the others stay in their tasks. Columns on must not be null in big."""
    maybe = fresh(big, "_nw_maybe")
    probed = possible_members(big, few, on, maybe)
    met = probed.where(F.col(maybe)).drop(maybe).join(few, on, how)
    if how == "inner":
        return met
    return met.unionByName(probed.where(~F.col(maybe)).drop(maybe), allowMissingColumns=True)
