"""Order messages, mids and integrity streams, derived from the tables of a folder.

Every order is explicit: messages of one order are ordered by
(ts, kind, line, part, supp), and that order is what a global sequence would
give, so nothing has to be numbered in one task.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

ORDER = ["ts", "kind", "line", "part", "supp"]
#: The same text for both engines but for integer division.
MESSAGES = """
  SELECT o_orderdate AS ts, 0 AS kind, o_orderkey + 1 AS order_id, 'A' AS tag,
         concat('SYM', lpad(CAST(o_custkey % 16 AS {text}), 5, '0')) AS symbol,
         CASE WHEN o_orderkey % 2 = 0 THEN 'B' ELSE 'S' END AS side,
         25 + (o_orderkey * 7) % 150 AS qty,
         1000000 + (CASE WHEN o_orderkey % 2 = 0 THEN -100 ELSE 100 END) * (1 + (o_orderkey {div} 2) % 32) AS px_raw,
         0 AS line, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS supp
  FROM {orders}
  UNION ALL
  SELECT l_shipdate, 1, l_orderkey + 1,
         CASE WHEN l_returnflag = 'A' THEN 'E' WHEN l_returnflag = 'R' THEN 'X' WHEN l_linestatus = 'F' THEN 'C' ELSE 'D' END,
         NULL, NULL, CAST(l_quantity AS BIGINT), NULL, l_linenumber, l_partkey, l_suppkey
  FROM {lineitem}
"""
MESSAGES_DUCK = MESSAGES.format(text="VARCHAR", div="//", orders="orders", lineitem="lineitem")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, kind, order_id, tag, symbol, side, qty, px_raw, line, part, supp)."""
    return spark.sql(MESSAGES.format(text="STRING", div="DIV", orders="{orders}", lineitem="{lineitem}"), orders=read(spark, sf_dir, "orders"), lineitem=read(spark, sf_dir, "lineitem"))


def in_sessions(messages: DataFrame, sessions: int = 64) -> DataFrame:
    """messages with session, and seq from 1 by session in order.

    A session's days are numbered by themselves, so that no session is sorted in
    one task; each day starts from the counts of those before it, a small table
    of one row for each session and day.
    """
    m = messages.withColumns({"session": F.col("order_id") % sessions, "day": F.to_date("ts")})
    past = Window.partitionBy("session").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    counts = m.groupBy("session", "day").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("session").alias("s"), F.col("day").alias("d"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("start"))
    near = m.withColumn("near", F.row_number().over(Window.partitionBy("session", "day").orderBy(*ORDER, "order_id")))
    both = near.join(F.broadcast(starts), F.col("session").eqNullSafe(F.col("s")) & F.col("day").eqNullSafe(F.col("d")))
    return both.select(*messages.columns, "session", (F.col("start") + F.col("near")).alias("seq"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided mids: (symbol, seq, ts_us, mid_raw)."""
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).alias("symbol"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), (1000000 + 100 * F.round("value").cast("long")).alias("mid_raw"), "event_type")


OBS_DUCK = "SELECT user_id % 4 AS symbol, event_id AS seq, epoch_us(ts) AS ts_us, 1000000 + 100 * CAST(round(value) AS BIGINT) AS mid_raw, event_type FROM events"


def fills(obs: DataFrame) -> DataFrame:
    """One fill for each purchase: (symbol, seq, ts_us, mid_raw, s, px_raw, size); s is 1 for a buy, -1 for a sale."""
    buy = F.col("seq") % 2 == 0
    return obs.where("event_type = 'purchase'").select("symbol", "seq", "ts_us", "mid_raw", F.when(buy, 1).otherwise(-1).cast("long").alias("s"), (F.col("mid_raw") - F.when(buy, 100).otherwise(-100)).alias("px_raw"), (1 + F.col("seq") % 100).alias("size"))


FILLS_DUCK = "SELECT symbol, seq, ts_us, mid_raw, CAST(CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS s, mid_raw - CASE WHEN seq % 2 = 0 THEN 100 ELSE -100 END AS px_raw, 1 + seq % 100 AS size FROM obs WHERE event_type = 'purchase'"


def transmissions(spark: SparkSession, sf_dir: str, bucket: int = 1 << 16) -> DataFrame:
    """A message stream with gaps and repetitions: (session, arrival, observed); sessions are numbered in buckets of ids."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("session"), F.col("event_id").alias("id"))
    parts = e.withColumn("bucket", F.expr(f"id DIV {bucket}"))
    earlier = parts.groupBy("session", "bucket").agg(F.count("*").alias("here")).select(F.col("session").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("here").over(Window.partitionBy("session").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    near = F.row_number().over(Window.partitionBy("session", "bucket").orderBy("id"))
    numbered = parts.join(F.broadcast(earlier), F.col("session").eqNullSafe(F.col("s")) & F.col("bucket").eqNullSafe(F.col("b"))).select("session", "id", (F.col("start") + near).alias("n"))
    sent = numbered.select("session", (2 * F.col("n")).alias("arrival"), (F.col("n") + F.expr("3 * (n DIV 500)")).alias("observed"))
    again = sent.where("arrival DIV 2 % 97 = 0").select("session", (F.col("arrival") + 1).alias("arrival"), F.col("observed"))
    return sent.union(again)


TRANSMISSIONS_DUCK = """sent AS (SELECT user_id % 4 AS session, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS n FROM events),
tr AS (SELECT session, 2 * n AS arrival, n + 3 * (n // 500) AS observed FROM sent UNION ALL SELECT session, 2 * n + 1, n + 3 * (n // 500) FROM sent WHERE n % 97 = 0)"""

#: Replaces: a quarter of orders once, an eighth twice, and some into an id that another order may hold.
REPLACES = """
  SELECT o_orderdate + INTERVAL {days} DAY AS ts, 2 AS kind, o_orderkey + 1 + {old} AS order_id, 'U' AS tag,
         CAST(NULL AS {text}) AS symbol, CAST(NULL AS {text}) AS side, CAST(50 AS BIGINT) AS qty,
         1000000 + (CASE WHEN o_orderkey % 2 = 0 THEN -100 ELSE 100 END) * (1 + o_orderkey % 8) AS px_raw,
         0 AS line, CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS supp, {new} AS new_id
  FROM {orders} WHERE {which}"""
STEPS = [(10, 0, "o_orderkey + 1 + 1000000000000", "o_orderkey % 4 = 1"), (20, 1000000000000, "o_orderkey + 1 + 2000000000000", "o_orderkey % 8 = 1"), (10, 0, "o_orderkey + 2", "o_orderkey % 16 = 3")]


def replaces_text(orders: str, text: str) -> str:
    return " UNION ALL ".join(REPLACES.format(days=d, old=o, new=n, which=w, orders=orders, text=text) for d, o, n, w in STEPS)


REPLACES_DUCK = replaces_text("orders", "VARCHAR")


def replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(replaces_text("{orders}", "STRING"), orders=read(spark, sf_dir, "orders"))


def with_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, and replaces with new_id."""
    return messages(spark, sf_dir).withColumn("new_id", F.lit(None).cast("long")).unionByName(replaces(spark, sf_dir))
