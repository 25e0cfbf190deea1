"""Snapshots of books: written with a checksum for each symbol, and restored with the orders' states."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import book


def write(orders: DataFrame, path: str) -> None:
    """orders (order_id, symbol, side, px_raw, size, state, ts) and each symbol's checksum, as Parquet."""
    orders.write.parquet(f"{path}/orders")
    book.checksums(orders.sparkSession.read.parquet(f"{path}/orders")).write.parquet(f"{path}/checksums")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/orders")


def verified(spark: SparkSession, path: str, orders: DataFrame | None = None) -> DataFrame:
    """(symbol, checksum, ok): whether orders, by default the snapshot's own, have the checksums that were written; a symbol that either lacks is not ok."""
    kept = spark.read.parquet(f"{path}/checksums")
    now = book.checksums(read(spark, path) if orders is None else orders).withColumnRenamed("checksum", "now")
    return kept.join(now, "symbol", "full_outer").select("symbol", "checksum", F.col("checksum").eqNullSafe(F.col("now")).alias("ok"))


def as_messages(orders: DataFrame, like: DataFrame) -> DataFrame:
    """A snapshot's orders as adds with the columns of like, and state, which they start with."""
    made = {"kind": F.lit(0), "tag": F.lit("A"), "qty": F.col("size"), **{c: F.lit(0).cast(dict(like.dtypes)[c]) for c in ("line", "part", "supp")}}
    return orders.withColumns(made).select(*like.columns, "state")


def restored(orders: DataFrame, after: DataFrame) -> DataFrame:
    """The live orders after a snapshot's orders and the messages after it; partly filled orders stay so until a message tells otherwise."""
    return book.live_orders(as_messages(orders, after).unionByName(after.withColumn("state", F.lit(None).cast("int"))))
