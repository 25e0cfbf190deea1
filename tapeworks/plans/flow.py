"""Queries of the book over time, of replaced orders, and of routing."""

from pyspark.sql import functions as F

from ..operators import book, routing
from ..sources import tables
from .queries import FOLD, live, query

FIRST, LAST = "1992-01-01", "2000-01-01"
AT_TIMES = f""" SELECT symbol, month, max(CASE WHEN side = 'B' THEN px_raw END) AS best_bid, min(CASE WHEN side = 'S' THEN px_raw END) AS best_ask, count(*) AS live_orders
FROM (SELECT *, lead(told) OVER (PARTITION BY order_id ORDER BY rn) AS until FROM fold) f
JOIN (SELECT unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL 1 MONTH)) AS month) t ON f.told < t.month AND (f.until IS NULL OR f.until >= t.month)
WHERE f.live GROUP BY symbol, month"""


@query("j11_bbo_at_t", FOLD + AT_TIMES)
def j11(spark, sf_dir):
    return book.top_at(tables.messages(spark, sf_dir), FIRST, LAST)


SPLIT = "1996-01-01"
LEVELS = "SELECT symbol, side, px_raw, CAST(sum({s}) AS BIGINT) AS agg_size, count(*) AS order_count FROM {f} GROUP BY symbol, side, px_raw"
STATE_AT = f", early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY rn DESC) AS back FROM fold WHERE told IS NULL OR told < TIMESTAMP '{SPLIT}') x WHERE back = 1 AND live), l1 AS ({LEVELS.format(s='rem', f='early')}), l2 AS ({LEVELS.format(s='size', f='live')})"


@query("j10_diff", FOLD + STATE_AT + " SELECT *, 'one' AS have FROM (SELECT * FROM l1 EXCEPT ALL SELECT * FROM l2) a UNION ALL SELECT *, 'other' FROM (SELECT * FROM l2 EXCEPT ALL SELECT * FROM l1) b")
def j10(spark, sf_dir):
    m = tables.messages(spark, sf_dir)
    early = m.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    return book.differences(book.levels(book.live_orders(early)), book.levels(book.live_orders(m)))


@query("b10_dense_slots", FOLD + " SELECT symbol, side, px_raw, CASE WHEN px_raw BETWEEN 998000 AND 1001900 AND (px_raw - 998000) % 200 = 0 THEN (px_raw - 998000) // 200 END AS slot FROM live GROUP BY symbol, side, px_raw")
def b10(spark, sf_dir):
    return book.slots(book.levels(live(spark, sf_dir)), 998_000, 200, 20).select("symbol", "side", "px_raw", "slot")


@query("o10_fingerprint", FOLD + " SELECT symbol, count(*) AS orders, CAST(sum(size) AS BIGINT) AS shares, CAST(sum(size * px_raw) AS BIGINT) AS notional, count(DISTINCT CASE WHEN side = 'B' THEN px_raw END) AS bid_levels, count(DISTINCT CASE WHEN side = 'S' THEN px_raw END) AS ask_levels FROM live GROUP BY symbol")
def o10(spark, sf_dir):
    levels = book.levels(live(spark, sf_dir)).withColumn("notional", F.expr("agg_size * px_raw"))
    return levels.groupBy("symbol").agg(F.sum("order_count").alias("orders"), F.sum("agg_size").alias("shares"), F.sum("notional").alias("notional"), F.count_if(F.col("side") == "B").alias("bid_levels"), F.count_if(F.col("side") == "S").alias("ask_levels"))


@query("j04_replace_pairs", f"WITH u AS ({tables.REPLACES_DUCK}) SELECT u.order_id, u.new_id, v.new_id AS then_id FROM u LEFT JOIN u v ON v.order_id = u.new_id")
def j04(spark, sf_dir):
    u = tables.replaces(spark, sf_dir).select("order_id", "new_id")
    return u.join(u.select(F.col("order_id").alias("new_id"), F.col("new_id").alias("then_id")), "new_id", "left").select("order_id", "new_id", "then_id")


HASH = "list_reduce(list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT))"
SYMBOLS = f"WITH m AS ({tables.MESSAGES_DUCK}), s AS (SELECT DISTINCT symbol FROM m WHERE symbol IS NOT NULL), h AS (SELECT symbol, {HASH.format(s='symbol')} AS h FROM s)"


def symbols(spark, sf_dir):
    return tables.messages(spark, sf_dir).where("symbol IS NOT NULL").select("symbol").distinct()


@query("p01_shard", SYMBOLS + " SELECT symbol, CAST(h % 6 AS BIGINT) AS shard FROM h")
def p01(spark, sf_dir):
    return symbols(spark, sf_dir).select("symbol", routing.shard(F.col("symbol"), 6).cast("long").alias("shard"))


@query("p02_claims", f"WITH m AS ({tables.MESSAGES_DUCK}), f AS (SELECT symbol, min((ts, order_id)) AS f FROM m WHERE symbol IS NOT NULL GROUP BY symbol), n AS (SELECT symbol, row_number() OVER (ORDER BY f, symbol) - 1 AS idx FROM f) SELECT symbol, idx, idx % 3 AS worker FROM n")
def p02(spark, sf_dir):
    return routing.claims(tables.messages(spark, sf_dir), ["ts", "order_id"], 3)


OVERRIDES, DOWN, SHARDS = {"SYM00003": 5, "SYM00009": 1}, {1, 2}, 6
HOME = "CASE symbol WHEN 'SYM00003' THEN 5 WHEN 'SYM00009' THEN 1 ELSE CAST(h % 6 AS BIGINT) END"


@query("p03_routes", SYMBOLS + f", r AS (SELECT symbol, {HOME} AS home FROM h) SELECT symbol, home, CASE WHEN home IN (1, 2) THEN CASE WHEN (home + 1) % 6 IN (1, 2) THEN (home + 2) % 6 ELSE (home + 1) % 6 END ELSE home END AS shard FROM r")
def p03(spark, sf_dir):
    return routing.routes(symbols(spark, sf_dir), SHARDS, OVERRIDES, DOWN)


@query("p04_rebalanced", "WITH e AS (SELECT concat('SYM', user_id % 16) AS symbol, event_id AS seq, event_type FROM events), h AS (SELECT DISTINCT symbol, " + HASH.format(s="symbol") + " AS h FROM e), c AS (SELECT symbol, seq, seq % 7 AS shard FROM e WHERE seq % 100 = 5 AND seq % 7 < 6) SELECT e.symbol, e.seq, coalesce(c.shard, CAST(h.h % 6 AS BIGINT)) AS home FROM e JOIN h USING (symbol) ASOF LEFT JOIN c ON e.symbol = c.symbol AND e.seq > c.seq")
def p04(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select(F.concat(F.lit("SYM"), F.col("user_id") % 16).alias("symbol"), F.col("event_id").alias("seq"))
    control = e.where("seq % 100 = 5").withColumn("shard", F.col("seq") % 7)
    return routing.routes_over_time(e, control, SHARDS)


@query("w13_global_sequence", f"SELECT order_id, tag, line, part, supp, row_number() OVER (ORDER BY ts, kind, order_id, line, part, supp) - 1 AS global_seq FROM ({tables.MESSAGES_DUCK}) m")
def w13(spark, sf_dir):
    n = routing.numbered(tables.messages(spark, sf_dir), [F.col("ts"), F.col("kind"), F.expr("order_id DIV 65536")], ["order_id", "line", "part", "supp"])
    return n.select("order_id", "tag", "line", "part", "supp", "global_seq")
