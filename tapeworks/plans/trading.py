"""Queries of risk checks, the order manager, sessions, the market maker and fills."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.prices import thousands
from ..operators import book, maker, manager, risk, series, session
from ..operators.prefix import before
from ..sources import shared, tables
from . import steps
from .queries import OBS, SIGMA, query

EVENTS = ["order", "order", "order", "fill", "order", "order", "unfill", "order"]


def choice(options: list[str], at):
    return F.element_at(F.array(*(F.lit(x) for x in options)), (at % len(options)).cast("int") + 1)


def flow(spark, sf_dir, kinds: list[str]):
    """Events by account, with orders about the account's previous price."""
    e = tables.read(spark, sf_dir, "events").withColumns({"account": F.col("user_id") % 16, "price": 1000000 + 100 * F.round("value").cast("long")})
    w = Window.partitionBy("account").orderBy("event_id")
    kind = F.when(F.col("event_id") % 1500 == 1499, F.lit("kill")).when(F.col("event_id") % 1500 < 16, F.lit("reset")).otherwise(choice(kinds, F.expr("event_id DIV 16")))
    return e.select("account", F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), kind.alias("event"), F.when(F.expr("event_id DIV 3 % 2 = 0"), "B").otherwise("S").alias("side"), "price", (F.col("event_id") % 401).alias("qty"), F.lag("price").over(w).alias("reference"), (F.col("event_id") % 5).alias("slot"))


TIGHT = {**risk.LIMITS, "position": 3000, "gross": 5000}


@query("r05_checked", steps.checked(TIGHT, EVENTS))
def r05(spark, sf_dir):
    """The whole chain of checks with positions that fills move."""
    return risk.checked(flow(spark, sf_dir, EVENTS), TIGHT)


@query("r06_kill_switch", "WITH e AS (SELECT user_id % 16 AS account, event_id AS seq, CASE WHEN event_id % 1500 = 1499 THEN true WHEN event_id % 1500 < 16 THEN false END AS kill FROM events) SELECT account, seq, coalesce(last_value(kill IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS engaged FROM e")
def r06(spark, sf_dir):
    switch = F.when(F.col("event") == "kill", True).when(F.col("event") == "reset", False)
    w = Window.partitionBy("account").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return flow(spark, sf_dir, EVENTS).select("account", "seq", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(False)).alias("engaged"))


STEPS = ["submit", "ack", "fill", "cancel", "cancel_ack", "submit", "fill", "ack", "replace", "replace_ack", "fill", "reject"]


def managed(spark, sf_dir):
    e = flow(spark, sf_dir, STEPS).where("event <> 'reset'")
    qty = F.when(F.col("event") == "fill", F.col("qty") % 60).otherwise(F.col("qty"))
    return manager.managed(e.withColumn("qty", qty))


MANAGED = steps.managed(risk.LIMITS, STEPS)


@query("m02_order_manager", f"{MANAGED} SELECT * FROM managed")
def m02(spark, sf_dir):
    return managed(spark, sf_dir)


@query("a10_reconciled", f"{MANAGED}, z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account, slot ORDER BY seq DESC) AS back FROM managed WHERE state IS NOT NULL) x WHERE back = 1) SELECT state, count(*) AS orders, CAST(sum(leaves) AS BIGINT) AS leaves FROM z GROUP BY state")
def a10(spark, sf_dir):
    return manager.reconciled(managed(spark, sf_dir))


@query("q06_session")
def q06(spark, sf_dir):
    """Transmissions as a client hears them, with a heartbeat after every tenth and each gap made good three messages later."""
    t = tables.transmissions(spark, sf_dir)
    one = F.lit(None).cast("long")
    messages = t.select("session", (4 * F.col("arrival")).alias("n"), F.lit("message").alias("event"), F.col("observed").alias("number"))
    beats = t.where("arrival % 20 = 0").select("session", (4 * F.col("arrival") + 1).alias("n"), F.lit("heartbeat").alias("event"), F.col("observed").alias("number"))
    done = t.where("arrival DIV 2 % 500 = 3").select("session", (4 * F.col("arrival") + 2).alias("n"), F.lit("done").alias("event"), (F.col("observed") + 1).alias("number"))
    start = t.groupBy("session").agg(F.min("observed").alias("first"))
    opened = [start.select("session", F.lit(i).cast("long").alias("n"), F.lit(e).alias("event"), (F.col("first") - 1 if i else one).alias("number")) for i, e in enumerate(("login", "accepted"))]
    events = messages.unionByName(beats).unionByName(done).unionByName(opened[0]).unionByName(opened[1])
    return session.followed(events.withColumn("ts_us", 1000 * F.col("n")), 60_000)


@query("q05_login", "SELECT user_id, 'L' || rpad('user' || user_id, 10, ' ') || rpad('pass' || user_id % 7, 10, ' ') AS request FROM (SELECT DISTINCT user_id FROM events) u")
def q05(spark, sf_dir):
    u = tables.read(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", F.decode(session.login_request(F.concat(F.lit("user"), "user_id"), F.concat(F.lit("pass"), F.col("user_id") % 7)), "ISO-8859-1").alias("request"))


def tops(spark, sf_dir):
    return book.tops(tables.messages(spark, sf_dir))


@query("t06_market_maker")
def t06(spark, sf_dir):
    return maker.made(tops(spark, sf_dir))


@query("a11_maker_profit")
def a11(spark, sf_dir):
    """(symbol, fills, peak, equity, worst_step, best_step, drawdown) of the market maker's run."""
    made = shared.cut(maker.made(tops(spark, sf_dir)).select("symbol", "n", "mid_raw", "fill", "position", "cash"))
    zero = F.lit(0).cast("long")
    held = before(made, {"had": ("position", "last"), "spent": ("cash", "last")}, order="n")
    equity = F.coalesce("spent", zero) + F.coalesce("had", zero) * F.col("mid_raw")
    past = before(held.select("symbol", "n", "fill", "position", equity.alias("equity")), {"last": ("equity", "last"), "most": ("equity", "max")}, order="n")
    steps = past.withColumns({"step": F.col("equity") - F.coalesce("last", zero), "high": F.greatest("most", "equity", zero)})
    return steps.groupBy("symbol").agg(F.count("fill").alias("fills"), F.max(F.abs("position")).alias("peak"), F.max_by("equity", "n").alias("equity"), F.min("step").alias("worst_step"), F.max("step").alias("best_step"), F.max(F.col("high") - F.col("equity")).alias("drawdown"))


@query("t08_queue_fills")
def t08(spark, sf_dir):
    """Each order as a resting order behind 30 shares: executions of it trade at its price, cancels take from those ahead."""
    m = tables.messages(spark, sf_dir)
    of_order = Window.partitionBy("order_id")
    # messages are numbered before they meet their add, so that they are sorted once; one that meets several counts once for each
    near = m.withColumn("near", F.row_number().over(of_order.orderBy(*tables.ORDER)))
    adds = m.where("tag = 'A'").select("order_id", F.col("px_raw").alias("px"), F.row_number().over(of_order.orderBy("px_raw")).alias("which"), F.count("*").over(of_order).alias("adds"))
    kind = F.when(F.col("tag") == "A", "place").when(F.col("tag").isin("E", "C"), "trade").otherwise("cancel")
    n = (F.col("near") - 1) * F.col("adds") + F.col("which")
    day = F.datediff("ts", F.lit("1970-01-01")).cast("long")
    e = near.join(adds, "order_id").select(F.col("order_id").alias("placement"), n.cast("long").alias("n"), day.alias("ts"), kind.alias("event"), F.col("px").alias("px_raw"), "qty", F.lit(30).cast("long").alias("ahead"))
    return maker.queue_fills(e, 5)


@query("t02_model_quotes", SIGMA + """, x AS (SELECT symbol, seq, mid_raw, round(sigma, 6) / 100 AS sigma, seq % 41 - 20 AS inventory, 1 + seq % 300 AS bid_size, CASE WHEN seq % 3 = 0 THEN 40 END AS ask_size FROM s),
h AS (SELECT *, 0.0025 * sigma * sigma * 250.0 AS risk FROM x), g AS (SELECT *, greatest(0.5 * (0.5 * risk + ln(1 + 0.0025 / 1.5) / 0.0025), 50.0) AS half, mid_raw - inventory * risk AS middle FROM h)
SELECT symbol, seq, CAST(round(middle - (half + (ln(bid_size) - ln(10)) / 1.5)) AS BIGINT) AS bid, CAST(round(middle + (half + coalesce((ln(ask_size) - ln(10)) / 1.5, 0.0))) AS BIGINT) AS ask FROM g""")
def t02_model(spark, sf_dir):
    obs = tables.observations(spark, sf_dir)
    x = series.volatility(obs).select("symbol", "seq", "mid_raw", (F.col("sigma") / 100).alias("sigma"), (F.col("seq") % 41 - 20).alias("inventory"), (1 + F.col("seq") % 300).alias("bid_size"), F.when(F.col("seq") % 3 == 0, F.lit(40)).alias("ask_size"))
    return maker.model_quotes(x).select("symbol", "seq", "bid", "ask")


@query("a11_peaks", OBS + ", p AS (SELECT symbol, seq, sum(s * size) OVER (PARTITION BY symbol ORDER BY seq) AS position FROM fills) SELECT symbol, CAST(max(abs(position)) AS BIGINT) AS peak FROM p GROUP BY symbol")
def a11_peaks(spark, sf_dir):
    return series.positions(tables.fills(tables.observations(spark, sf_dir))).groupBy("symbol").agg(F.max(F.abs("position")).alias("peak"))


@query("a12_thousands", "SELECT event_type, replace(format('{:,}', CAST(sum(event_id) AS BIGINT)), ',', ' ') AS ids FROM events GROUP BY event_type")
def a12(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").groupBy("event_type").agg(thousands(F.sum("event_id")).alias("ids"))
