"""Where a symbol's messages are worked on: shards, workers, overrides and standbys; and global numbers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashes


def shard(symbol: Column, shards: int) -> Column:
    """A symbol's shard, by the hash of its text without trailing blanks."""
    return hashes.modulo(hashes.text_hash(F.rtrim(symbol)), shards)


def claims(messages: DataFrame, order: list[str], workers: int) -> DataFrame:
    """(symbol, idx, worker): symbols numbered by first appearance, and dealt to workers in turn."""
    first = messages.where("symbol IS NOT NULL").groupBy("symbol").agg(F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(Window.orderBy("first", "symbol")) - 1
    return first.select("symbol", n.cast("long").alias("idx")).withColumn("worker", F.col("idx") % workers)


def routes(symbols: DataFrame, shards: int, overrides: dict[str, int], down: set[int]) -> DataFrame:
    """symbols with home and shard: an override or the hash; a shard that is down gives to the next, or the one after it."""
    named = F.create_map(*(F.lit(x) for kv in overrides.items() for x in kv)) if overrides else None
    hashed = shard(F.col("symbol"), shards).cast("long")
    home = F.coalesce(F.try_element_at(named, F.col("symbol")).cast("long"), hashed) if named is not None else hashed
    is_down = lambda c: c.isin(*down) if down else F.lit(False)
    one, two = (F.col("home") + 1) % shards, (F.col("home") + 2) % shards
    standby = F.when(is_down(one) & F.lit(shards > 1), two).otherwise(one)
    return symbols.withColumn("home", home).withColumn("shard", F.when(is_down(F.col("home")), standby).otherwise(F.col("home")))


def routes_over_time(messages: DataFrame, control: DataFrame, shards: int) -> DataFrame:
    """(symbol, seq, home): each message's shard under the last rebalance of its symbol before it.

    control: (symbol, seq, shard). One window by symbol and number stands for
    the backward as-of join; shards out of range are no rebalance.
    """
    w = Window.partitionBy("symbol").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, 0)
    moves = control.where((F.col("shard") >= 0) & (F.col("shard") < shards)).select("symbol", "seq", F.lit(1).alias("kind"), F.col("shard").cast("long").alias("to"))
    both = messages.select("symbol", "seq", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("to")).unionByName(moves)
    held = both.withColumn("held", F.last("to", ignorenulls=True).over(w)).where("kind = 0")
    return held.select("symbol", "seq", F.coalesce("held", shard(F.col("symbol"), shards).cast("long")).alias("home"))


def numbered(messages: DataFrame, bucket: list[Column], order: list[str]) -> DataFrame:
    """messages with global_seq, from 0 in the order of (bucket, order).

    Only the buckets' counts are summed in one task; rows are numbered within
    their buckets, so buckets should be many and small.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    rows = messages.select("*", *(b.alias(n) for b, n in zip(bucket, names, strict=True)))
    before = F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*names).agg(F.count("*").alias("_n")).select(*names, F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1
    return rows.join(starts, names).withColumn("global_seq", F.col("_start") + within).drop(*names, "_start")
