"""Series of mids: returns, volatility, quotes, fills, markouts, position and profit."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import before

#: Returns in a volatility, observations in a piece of work, and microseconds in a piece of time.
WINDOW, PIECE, SPAN_US = 256, 1 << 14, 3_600_000_000


def changes(obs: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    rows = before(obs.select("symbol", "seq", "mid_raw"), {"last": ("mid_raw", "last")}, bucket)
    return rows.select("symbol", "seq", "mid_raw", (F.col("mid_raw") - F.col("last")).alias("delta"))


def moves(obs: DataFrame) -> DataFrame:
    """(symbol, observations, moves): how often the mid was another than before."""
    return changes(obs).groupBy("symbol").agg(F.count("*").alias("observations"), F.count_if(F.coalesce(F.col("delta"), F.lit(0)) != 0).alias("moves"))


def pieces(obs: DataFrame, size: int, overlap: int, bucket: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, piece, own, seq, mid_raw, *keep): each symbol's observations in pieces of size rows, and before each the last overlap rows of the one before.

    own is false for the latter. Rows are numbered by symbol from the counts of
    buckets of seq, so that no symbol has to be sorted in one task.
    """
    rows = obs.select("symbol", "seq", "mid_raw", *keep, F.expr(f"seq DIV {bucket}").alias("bucket"))
    w = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("symbol", "bucket").agg(F.count("*").alias("n")).select("symbol", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))
    n = F.col("start") + F.row_number().over(Window.partitionBy("symbol", "bucket").orderBy("seq")) - 1
    numbered = rows.join(starts, ["symbol", "bucket"]).select("symbol", "seq", "mid_raw", *keep, n.alias("n"))
    home = F.expr(f"n DIV {size}")
    both = F.when(F.col("n") % size >= size - overlap, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.select("symbol", "seq", "mid_raw", *keep, home.alias("home"), F.explode(both).alias("piece")).select("symbol", "piece", (F.col("home") == F.col("piece")).alias("own"), "seq", "mid_raw", *keep)


def sigmas(mid: np.ndarray, window: int) -> np.ndarray:
    """After each of the mids in order: the root mean square of the last window returns, each held within four times their median size."""
    out = np.zeros(len(mid))
    delta = np.abs(np.diff(mid.astype(np.int64)))
    for lo in range(2, len(mid), 4096):
        hi = min(len(mid), lo + 4096)
        # returns up to each observation, the oldest places empty where there are fewer than window
        count = np.minimum(np.arange(lo, hi), window)
        most = int(count.max())
        padded = np.r_[np.full(max(0, most - lo), -1), delta[max(0, lo - most) : hi - 1]]
        last = np.lib.stride_tricks.sliding_window_view(padded, most)[: hi - lo]
        middle = most - count + count // 2  # empty places are the least
        kth = np.unique(middle)
        limit = 4 * np.partition(last, kth, axis=1)[np.arange(hi - lo), middle]
        held = np.where(limit[:, None] > 0, np.minimum(last, limit[:, None]), last)
        held[last < 0] = 0
        out[lo:hi] = np.sqrt((held * held).sum(axis=1) / count)
    return out


def raw_volatility(obs: DataFrame, window: int = WINDOW, size: int = PIECE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, seq, mid_raw, *keep, raw): sigmas() after each observation, unrounded, by pieces of a symbol."""
    columns = ["symbol", "seq", "mid_raw", *keep]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        sigma = sigmas(table["mid_raw"].to_numpy(), window)
        return table.append_column("raw", pa.array(sigma)).filter(table["own"]).select([*columns, "raw"])

    kinds = ", ".join(f"{c} {t}" for c, t in obs.select(*columns).dtypes)
    return pieces(obs, max(size, window), window, keep=keep).groupBy("symbol", "piece").applyInArrow(run, f"{kinds}, raw double")


def volatility(obs: DataFrame, window: int = WINDOW, size: int = PIECE) -> DataFrame:
    """(symbol, seq, sigma, sigma_fraction, mid_raw): root mean square of the last returns, each held within four times their median size."""
    raw = raw_volatility(obs, window, size)
    return raw.select("symbol", "seq", F.round("raw", 6).alias("sigma"), F.round(F.col("raw") / F.col("mid_raw"), 9).alias("sigma_fraction"), "mid_raw")


def positions(fills: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(symbol, seq, position, cash) after each fill."""
    rows = fills.select("symbol", "seq", F.expr("s * size").alias("q"), F.expr("s * size * px_raw").alias("paid"))
    held = before(rows, {"had": ("q", "sum"), "spent": ("paid", "sum")}, bucket)
    return held.select("symbol", "seq", (F.col("had") + F.col("q")).alias("position"), (-F.col("spent") - F.col("paid")).alias("cash"))


def profit(obs: DataFrame, fills: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(symbol, seq, equity, step, drawdown) at each observation; it is marked before its own fill counts."""
    both = obs.select("symbol", "seq", "mid_raw").join(fills.select("symbol", "seq", F.expr("s * size").alias("q"), F.expr("s * size * px_raw").alias("paid")), ["symbol", "seq"], "left")
    held = before(both, {"had": ("q", "sum"), "spent": ("paid", "sum")}, bucket).select("symbol", "seq", (F.col("had") * F.col("mid_raw") - F.col("spent")).alias("equity"))
    seen = before(held, {"last": ("equity", "last"), "most": ("equity", "max")}, bucket)
    zero = F.lit(0).cast("long")
    return seen.select("symbol", "seq", "equity", (F.col("equity") - F.coalesce("last", zero)).alias("step"), (F.greatest("most", "equity", zero) - F.col("equity")).alias("drawdown"))


def markouts(obs: DataFrame, fills: DataFrame, horizon_us: int, threshold: int = 0, span_us: int = SPAN_US) -> DataFrame:
    """Each fill with the first mid of its symbol at or after its time plus the horizon, the last one where there is none.

    One union and one running window stand for an as-of join. Backwards in
    time, the mid to take is the last one seen. Windows cover a symbol's spans
    of time one by one; a span that has none left takes the next span's first,
    from a table of one row for each symbol and span.
    """
    span = F.expr(f"at DIV {span_us}").alias("span")
    bare = ("mid_raw", "s", "px_raw", "size")
    seen = obs.select("symbol", F.col("ts_us").alias("at"), F.lit(1).alias("kind"), "seq", F.col("mid_raw").alias("mid_h"), *(F.lit(None).cast("long").alias(c) for c in bare))
    asked = fills.select("symbol", (F.col("ts_us") + horizon_us).alias("at"), F.lit(0).alias("kind"), "seq", F.lit(None).cast("long").alias("mid_h"), *bare)
    both = seen.union(asked).select("*", span)
    key = F.when(F.col("kind") == 1, F.struct("at", "seq"))
    ends = both.groupBy("symbol", "span").agg(F.min_by("mid_h", key).alias("first_mid"), F.max_by("mid_h", key).alias("last_mid"))
    back = Window.partitionBy("symbol").orderBy(F.desc("span"))
    every = back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select("symbol", "span", F.last("first_mid", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("next_mid"), F.first("last_mid", ignorenulls=True).over(every).alias("final_mid"))
    w = Window.partitionBy("symbol", "span").orderBy(F.desc("at"), F.desc("kind"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = both.withColumn("later", F.last("mid_h", ignorenulls=True).over(w)).where("kind = 0").join(carried, ["symbol", "span"])
    done = later.select("symbol", "seq", "s", "size", "px_raw", "mid_raw", F.coalesce("later", "next_mid", "final_mid").alias("mid_h"))
    return done.withColumns({"effective": F.expr("2 * s * (mid_raw - px_raw)"), "markout": F.expr("s * (mid_h - mid_raw)")}).withColumns({"realised": F.col("effective") - 2 * F.col("markout"), "toxic": F.col("markout") < -threshold})


def toxicity(resolved: DataFrame) -> DataFrame:
    n = F.count("*")
    return resolved.groupBy("symbol").agg(n.alias("fills"), F.count_if("toxic").alias("toxic"), F.sum("markout").alias("markout_sum"), F.sum("effective").alias("effective_sum"), F.sum("realised").alias("realised_sum"), F.round(F.count_if("toxic") / n, 6).alias("toxicity_rate"), F.round(2 * F.sum("markout") / n, 6).alias("adverse_cost"))


def quotes(obs: DataFrame, gamma: float = 0.0025, k: float = 1.5, horizon: float = 250.0) -> DataFrame:
    """(symbol, seq, bid, ask): risk-averse quotes about the mid at no inventory, never better than a tick from it."""
    v = volatility(obs)
    risk = F.lit(gamma) * F.pow(F.col("sigma") / 100, 2) * horizon
    half = 0.5 * (0.5 * risk + (1 / gamma) * F.log1p(F.lit(gamma / k)))
    wide = F.greatest(half, F.lit(1.0))
    return v.select("symbol", "seq", F.floor((F.col("mid_raw") - 100 * wide) / 100).cast("long").alias("bid_ticks"), F.ceil((F.col("mid_raw") + 100 * wide) / 100).cast("long").alias("ask_ticks"))


def histogram(values: DataFrame, width: int, buckets: int) -> DataFrame:
    """(bucket, n); values past the last bucket count in it as overflow."""
    return values.groupBy(F.least(F.expr(f"value DIV {width}"), F.lit(buckets).cast("long")).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(values: DataFrame, width: int, buckets: int, points: list[float]) -> DataFrame:
    """(p, value): the upper edge of the first bucket that reaches each share; the range's end in the overflow."""
    h = histogram(values, width, buckets)
    spark = values.sparkSession
    running = h.select("bucket", F.sum("n").over(Window.orderBy("bucket")).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    asked = spark.createDataFrame([(p,) for p in points], "p double")
    hit = asked.join(F.broadcast(running), F.col("below") >= F.greatest(F.floor(F.col("all") * F.col("p") + 0.5), F.lit(1)))
    return hit.groupBy("p").agg(F.min("bucket").alias("b")).select("p", F.least((F.col("b") + 1) * width, F.lit(width * buckets).cast("long")).alias("value"))
