"""The same questions of streams: order lives and sequence audits with state kept by key.

Sources must keep the order within a key, as a partitioned log does: a
micro-batch is sorted by key before it meets the state, and what comes later
is taken to be later.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import folds
from ..sources import shared, tables

CHANGES = "symbol string, side string, px_raw bigint, shares bigint, orders bigint"
#: One state holds the live orders of 2**SHIFT neighbouring ids, in arrays of equal lengths: a frame for each id would cost more than its rows.
SHIFT, HELD = 6, "ids array<bigint>, symbols array<string>, sides array<string>, prices array<bigint>, left array<bigint>"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of its files; the pattern lets it be one file or a folder."""
    return spark.readStream.schema(tables.read(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")


def finished(stream: DataFrame, kind: str) -> DataFrame:
    """What an append stream gives for all that is there now, through a sink and a checkpoint in the shared folder."""
    spark = stream.sparkSession
    to = shared.fresh(spark, kind)
    stream.writeStream.format("parquet").option("path", f"{to}/rows").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{to}/rows")


def level_changes(messages: DataFrame) -> DataFrame:
    """CHANGES: what each applied message adds to its level; an order leaves the state when it leaves the book."""

    columns = [*tables.ORDER, "order_id", "tag", "symbol", "side", "qty", "px_raw"]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((r for b in batches for r in zip(*(b[c] for c in columns), strict=True)), key=lambda r: r[: len(tables.ORDER)])
        live = {r[0]: list(r[1:]) for r in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        for order, tag, symbol, side, qty, px in (r[len(tables.ORDER) :] for r in rows):
            held, qty = live.get(order), int(qty)
            if tag == "A":
                if held is None and order and qty:
                    live[int(order)] = [symbol, side, int(px), qty]
                    out.append((symbol, side, int(px), qty, 1))
            elif held and (tag == "D" or qty <= held[3]):
                gone = held[3] if tag == "D" else qty
                held[3] -= gone
                if not held[3]:
                    del live[order]
                out.append((*held[:3], -gone, 0 if held[3] else -1))
        if live:
            state.update(tuple(map(list, zip(*((k, *v) for k, v in live.items()), strict=True))))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    return messages.withColumn("range", F.shiftright("order_id", SHIFT)).groupBy("range").applyInPandasWithState(follow, CHANGES, HELD, "append", GroupStateTimeout.NoTimeout)


def levels(changes: DataFrame) -> DataFrame:
    """(symbol, side, px_raw, agg_size, order_count) from changes; a batch or a streaming aggregation."""
    summed = changes.groupBy("symbol", "side", "px_raw").agg(F.sum("shares").alias("agg_size"), F.sum("orders").alias("order_count"))
    return summed.where("order_count > 0")


AUDITED = "session bigint, arrival bigint, observed bigint, expected bigint, state string, missing bigint"


def audited(stream: DataFrame) -> DataFrame:
    """AUDITED for all that is there now: each message against the number expected next, the state of its session.

    Each micro-batch is sorted by session and arrival, which spills, and folded;
    a session's state stands before its messages.
    """
    spark = stream.sparkSession
    to = shared.fresh(spark, "sequence")
    held = "session bigint, following bigint"

    def judge(key: tuple, rows: Iterator) -> Iterator[tuple]:
        following = None
        for r in rows:
            if not r.message:
                following = r.observed
                continue
            want = r.observed if following is None else following
            yield (*key, r.arrival, r.observed, want, "ok" if r.observed == want else "gap" if r.observed > want else "duplicate", max(r.observed - want, 0))
            following = max(want, r.observed + 1)

    def step(batch: DataFrame, n: int) -> None:
        here = batch.sparkSession
        before = here.read.schema(held).parquet(f"{to}/state-{n - 1}") if n else here.createDataFrame([], held)
        rows = batch.select("session", F.lit(True).alias("message"), "arrival", "observed")
        states = before.select("session", F.lit(False), F.lit(None).cast("bigint"), "following")
        folds.by_key(rows.union(states), ["session"], ["message", "arrival"], judge, AUDITED).write.mode("overwrite").parquet(f"{to}/rows/batch={n}")
        now = here.read.schema(AUDITED).parquet(f"{to}/rows/batch={n}").select("session", F.greatest("expected", F.col("observed") + 1).alias("following"))
        now.union(before).groupBy("session").agg(F.max("following").alias("following")).write.mode("overwrite").parquet(f"{to}/state-{n}")

    spark.createDataFrame([], AUDITED).write.parquet(f"{to}/rows/batch=-1")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(AUDITED).parquet(f"{to}/rows").select(*(c.split()[0] for c in AUDITED.split(", ")))


def once(messages: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Messages (ts, ...) without repetitions of keys that come within delay of each other."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
