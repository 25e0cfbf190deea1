"""The registered queries, each with the SQL that DuckDB answers it with."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prices
from ..operators import book, risk, sequence, series
from ..sources import snapshots, tables, wire
from . import steps

QUERIES: dict = {}
ORACLES: dict = {}
HORIZON_US = 60_000_000
WIDTH, BUCKETS = 2, 64
POINTS = [0.5, 0.9, 0.99, 1.0]


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: For DuckDB: one message's outcome and the state after it; {s}: state before, {m}: message.
OUTCOME = """CASE
  WHEN {m}tag = 'A' AND ({s}live OR {m}order_id = 0) THEN 'duplicate_order'
  WHEN {m}tag = 'A' AND {m}qty = 0 THEN 'zero_size'
  WHEN {m}tag = 'A' THEN 'ok'
  WHEN NOT {s}live THEN 'unknown_order'
  WHEN {m}tag <> 'D' AND {m}qty > {s}rem THEN 'over_reduce'
  ELSE 'ok' END"""
LIVE = "CASE WHEN {o} <> 'ok' THEN {s}live WHEN {m}tag = 'A' THEN true WHEN {m}tag = 'D' THEN false ELSE {m}qty < {s}rem END"
LEFT = "CASE WHEN {o} <> 'ok' THEN {s}rem WHEN {m}tag = 'A' THEN {m}qty WHEN {m}tag = 'D' THEN 0 ELSE {s}rem - {m}qty END"
STATE = """CASE WHEN {o} <> 'ok' THEN {s}state WHEN {m}tag = 'A' THEN 0 WHEN {m}tag = 'D' THEN 3
  WHEN {m}tag = 'X' THEN CASE WHEN {m}qty = {s}rem THEN 3 ELSE 0 END ELSE CASE WHEN {m}qty = {s}rem THEN 2 ELSE 1 END END"""


def fold_sql() -> str:
    """Orders' lives by recursion over each order's messages, in order."""
    s, m = "f.", "o."
    outcome = OUTCOME.format(s=s, m=m)
    live, left, state = (x.format(s=s, m=m, o=f"({outcome})") for x in (LIVE, LEFT, STATE))
    placed = f"({outcome}) = 'ok' AND o.tag = 'A'"
    keep = ", ".join(f"CASE WHEN {placed} THEN o.{c} ELSE f.{c} END AS {c}" for c in ("symbol", "side", "px_raw", "ts"))
    return f"""WITH RECURSIVE m AS ({tables.MESSAGES_DUCK}),
ord AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, kind, line, part, supp) AS rn FROM m),
fold AS (
  SELECT order_id, CAST(0 AS BIGINT) AS rn, false AS live, CAST(0 AS BIGINT) AS rem, 0 AS state, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS BIGINT) AS px_raw, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS TIMESTAMP) AS told
  FROM ord WHERE rn = 1
  UNION ALL
  SELECT f.order_id, o.rn, {live}, {left}, {state}, {keep}, o.tag, {outcome}, o.ts
  FROM fold f JOIN ord o ON o.order_id = f.order_id AND o.rn = f.rn + 1
),
live AS (SELECT order_id, symbol, side, px_raw, rem AS size, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY rn DESC) AS back FROM fold) x WHERE back = 1 AND live)"""


FOLD = fold_sql()
OBS = f"WITH obs AS ({tables.OBS_DUCK}), fills AS ({tables.FILLS_DUCK})"
#: For DuckDB: FNV-1a over numbers of 8 little-endian bytes.
HASH_BYTES = "list_reduce(flatten(list_transform({s}, lambda x: [x & 255, (x >> 8) & 255, (x >> 16) & 255, (x >> 24) & 255, (x >> 32) & 255, (x >> 40) & 255, (x >> 48) & 255, (x >> 56) & 255])), lambda h, b: (xor(CAST(h AS HUGEINT), CAST(b AS HUGEINT)) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT))"
BETTER = "CASE WHEN side = 'B' THEN -px_raw ELSE px_raw END"


def live(spark, sf_dir):
    return book.live_orders(tables.messages(spark, sf_dir))


@query("o01_bbo", FOLD + " SELECT symbol, max(CASE WHEN side = 'B' THEN px_raw END) AS best_bid, min(CASE WHEN side = 'S' THEN px_raw END) AS best_ask FROM live GROUP BY symbol")
def o01(spark, sf_dir):
    return book.bbo(live(spark, sf_dir))


@query("b14_outcomes", FOLD + " SELECT tag, outcome, live, count(*) AS n FROM fold WHERE rn > 0 GROUP BY ALL")
def b14(spark, sf_dir):
    return book.outcomes(tables.messages(spark, sf_dir))


@query("b03_order_state", FOLD + " SELECT order_id, symbol, side, px_raw, size, state FROM live")
def b03(spark, sf_dir):
    return live(spark, sf_dir).drop("ts")


@query("o02_lookup", FOLD + " SELECT e.event_id, l.order_id, l.size FROM (SELECT event_id, event_id * 7 + 1 AS wanted FROM events) e JOIN live l ON l.order_id = e.wanted")
def o02(spark, sf_dir):
    wanted = tables.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7 + 1).alias("order_id"))
    return wanted.join(live(spark, sf_dir), "order_id").select("event_id", "order_id", "size")


@query("o03_size_at", FOLD + " SELECT symbol, side, sum(size) AS agg_size FROM live WHERE px_raw IN (999500, 1000500) GROUP BY symbol, side")
def o03(spark, sf_dir):
    return book.levels(live(spark, sf_dir)).where(F.col("px_raw").isin(999500, 1000500)).select("symbol", "side", "agg_size")


@query("o04_side_totals", FOLD + " SELECT symbol, side, sum(size) AS total_size, count(*) AS order_count, count(DISTINCT px_raw) AS level_count FROM live GROUP BY symbol, side")
def o04(spark, sf_dir):
    return book.side_totals(live(spark, sf_dir))


@query("o05_levels", FOLD + " SELECT symbol, side, px_raw, sum(size) AS agg_size, count(*) AS order_count FROM live GROUP BY symbol, side, px_raw")
def o05(spark, sf_dir):
    return book.levels(live(spark, sf_dir))


@query("o05_topk_levels", FOLD + f" SELECT * FROM (SELECT symbol, side, px_raw, sum(size) AS agg_size, count(*) AS order_count, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY {BETTER}) AS INTEGER) AS level FROM live GROUP BY symbol, side, px_raw) x WHERE level <= 5")
def o05_topk(spark, sf_dir):
    return book.top_levels(live(spark, sf_dir), 5)


@query("o06_priority", FOLD + f" SELECT symbol, side, order_id, px_raw, size, state, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY {BETTER}, ts, order_id) AS INTEGER) AS priority FROM live")
def o06(spark, sf_dir):
    return book.priority(live(spark, sf_dir))


@query("o07_queue_position", FOLD + " SELECT symbol, side, px_raw, order_id, CAST(row_number() OVER w - 1 AS INTEGER) AS position, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shares_ahead FROM live WINDOW w AS (PARTITION BY symbol, side, px_raw ORDER BY ts, order_id)")
def o07(spark, sf_dir):
    return book.queue_positions(live(spark, sf_dir))


@query("o13_mid", FOLD + " SELECT symbol, (max(CASE WHEN side = 'B' THEN px_raw END) + min(CASE WHEN side = 'S' THEN px_raw END)) // 2 AS mid_raw FROM live GROUP BY symbol HAVING count(DISTINCT side) = 2")
def o13(spark, sf_dir):
    return book.mids(live(spark, sf_dir))


@query("a03_rollup", FOLD + " SELECT symbol, side, sum(size) AS total_size, count(*) AS order_count FROM live GROUP BY ROLLUP (symbol, side)")
def a03(spark, sf_dir):
    return book.totals(live(spark, sf_dir))


@query("a04_tag_counts", f"SELECT tag, count(*) AS n FROM ({tables.MESSAGES_DUCK}) m GROUP BY tag")
def a04(spark, sf_dir):
    return tables.messages(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))


@query("j01_route", f"WITH m AS ({tables.MESSAGES_DUCK}) SELECT a.symbol, c.tag, count(*) AS n FROM m c LEFT JOIN m a ON a.order_id = c.order_id AND a.tag = 'A' WHERE c.tag <> 'A' GROUP BY a.symbol, c.tag")
def j01(spark, sf_dir):
    return book.routed(tables.messages(spark, sf_dir))


@query("j02_orphans", f"WITH m AS ({tables.MESSAGES_DUCK}) SELECT c.order_id, count(*) AS n FROM m c LEFT JOIN m a ON a.order_id = c.order_id AND a.tag = 'A' WHERE c.tag <> 'A' AND (a.ts IS NULL OR c.ts < a.ts) GROUP BY c.order_id")
def j02(spark, sf_dir):
    return book.orphans(tables.messages(spark, sf_dir))


@query("j03_live_semi", FOLD + " SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM live WHERE live.order_id = o_orderkey + 1)")
def j03(spark, sf_dir):
    alive = live(spark, sf_dir).select((F.col("order_id") - 1).alias("o_orderkey"))
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(alive, "o_orderkey", "left_semi")


@query("p09_recovery", FOLD + " SELECT symbol, side, px_raw, sum(size) AS agg_size, count(*) AS order_count FROM live GROUP BY symbol, side, px_raw")
def p09(spark, sf_dir):
    """A snapshot's orders, and the messages after it, give the book that all messages give."""
    m = tables.messages(spark, sf_dir)
    at = F.lit("1996-01-01").cast("timestamp_ntz")
    return book.levels(snapshots.restored(book.live_orders(m.where(F.col("ts") < at)), m.where(F.col("ts") >= at)))


@query("s04_walk", f"SELECT tag, count(*) AS n, CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 ELSE 19 END AS shortest, CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 ELSE 19 END AS longest, 0 AS bad, sum(qty) FILTER (tag <> 'D') AS shares, sum(order_id) AS ids FROM ({tables.MESSAGES_DUCK}) m GROUP BY tag")
def s04(spark, sf_dir):
    """All messages as binary packets, walked and decoded again."""
    p = wire.packets(wire.encode(tables.in_sessions(tables.messages(spark, sf_dir))))
    d = wire.decode(wire.walk(p.select(F.col("session").alias("source"), "content")))
    return d.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.length("frame")).alias("shortest"), F.max(F.length("frame")).alias("longest"), F.count_if(F.col("status") != "ok").alias("bad"), F.sum("qty").cast("long").alias("shares"), F.sum("order_id").cast("long").alias("ids"))


@query("d16_price_format", f"SELECT px_raw, CAST(CAST(px_raw / 10000.0 AS DECIMAL(19,4)) AS VARCHAR) AS price, px_raw AS parsed, count(*) AS n FROM ({tables.MESSAGES_DUCK}) m WHERE tag = 'A' GROUP BY px_raw")
def d16(spark, sf_dir):
    n = tables.messages(spark, sf_dir).where("tag = 'A'").groupBy("px_raw").agg(F.count("*").alias("n"))
    return n.select("px_raw", prices.price_text(F.col("px_raw")).alias("price"), prices.parse_price(prices.price_text(F.col("px_raw"))).alias("parsed"), "n")


TR = "WITH " + tables.TRANSMISSIONS_DUCK + """,
audit AS (SELECT session, arrival, observed, coalesce(max(observed + 1) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), observed) AS expected FROM tr),
judged AS (SELECT *, CASE WHEN observed = expected THEN 'ok' WHEN observed > expected THEN 'gap' ELSE 'duplicate' END AS state, greatest(observed - expected, 0) AS missing FROM audit)"""


@query("q01_sequence_state", TR + " SELECT * FROM judged")
def q01(spark, sf_dir):
    return sequence.audited(tables.transmissions(spark, sf_dir))


@query("q03_sequence_totals", TR + " SELECT session, count(*) FILTER (state <> 'duplicate') AS accepted, sum(missing) AS missing, count(*) FILTER (state = 'gap') AS gaps, count(*) FILTER (state = 'duplicate') AS rejects, count(*) FILTER (state <> 'ok') = 0 AS clean FROM judged GROUP BY session")
def q03(spark, sf_dir):
    return sequence.totals(tables.transmissions(spark, sf_dir))


@query("w12_lag", TR + " SELECT session, max(max(arrival)) OVER () - max(arrival) AS lag FROM tr GROUP BY session")
def w12(spark, sf_dir):
    return sequence.lag_by_shard(tables.transmissions(spark, sf_dir))


@query("q10_clock_sync", "WITH s AS (SELECT user_id % 4 AS source, event_id AS seq, epoch_us(ts) AS local, CAST(round(value) AS BIGINT) AS \"offset\" FROM events), w AS (SELECT *, first_value(\"offset\") OVER v AS o0, first_value(local) OVER v AS l0, lag(\"offset\") OVER v AS last FROM s WINDOW v AS (PARTITION BY source ORDER BY seq)) SELECT source, seq, \"offset\", CASE WHEN local > l0 THEN (\"offset\" - o0) * 1000000000 // (local - l0) ELSE 0 END AS drift_ppb, coalesce(abs(\"offset\" - last) > 5, true) AS stepped FROM w")
def q10(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    local = F.unix_micros(F.col("ts").cast("timestamp"))
    return sequence.clock_offsets(e.select((F.col("user_id") % 4).alias("source"), F.col("event_id").alias("seq"), local.alias("local"), (local + F.round("value").cast("long")).alias("remote")), 5)


@query("w03_mid_change", OBS + " SELECT symbol, seq, mid_raw, mid_raw - lag(mid_raw) OVER (PARTITION BY symbol ORDER BY seq) AS delta FROM obs")
def w03(spark, sf_dir):
    return series.changes(tables.observations(spark, sf_dir))


@query("o14_mid_moves", OBS + ", d AS (SELECT symbol, mid_raw - lag(mid_raw) OVER (PARTITION BY symbol ORDER BY seq) AS delta FROM obs) SELECT symbol, count(*) AS observations, count(*) FILTER (delta <> 0) AS moves FROM d GROUP BY symbol")
def o14(spark, sf_dir):
    return series.moves(tables.observations(spark, sf_dir))


SIGMA = OBS + """, d AS (SELECT symbol, seq, mid_raw, mid_raw - lag(mid_raw) OVER (PARTITION BY symbol ORDER BY seq) AS delta FROM obs),
l AS (SELECT symbol, seq, mid_raw, coalesce(list(delta) FILTER (delta IS NOT NULL) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 255 PRECEDING AND CURRENT ROW), []) AS d FROM d),
m AS (SELECT *, list_sort(list_transform(d, lambda x: abs(x)))[len(d) // 2 + 1] AS m FROM l),
q AS (SELECT *, list_sum(list_transform(d, lambda x: CASE WHEN m > 0 THEN greatest(least(x, 4 * m), -4 * m) ELSE x END * CASE WHEN m > 0 THEN greatest(least(x, 4 * m), -4 * m) ELSE x END)) AS squares FROM m),
s AS (SELECT symbol, seq, mid_raw, CASE WHEN len(d) < 2 THEN 0.0 ELSE sqrt(CAST(squares AS DOUBLE) / len(d)) END AS sigma FROM q)"""


@query("w05_sigma", SIGMA + " SELECT symbol, seq, round(sigma, 6) AS sigma, round(sigma / mid_raw, 9) AS sigma_fraction FROM s")
def w05(spark, sf_dir):
    return series.volatility(tables.observations(spark, sf_dir)).drop("mid_raw")


@query("w07_position", OBS + " SELECT symbol, seq, sum(s * size) OVER w AS position, -sum(s * size * px_raw) OVER w AS cash FROM fills WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def w07(spark, sf_dir):
    return series.positions(tables.fills(tables.observations(spark, sf_dir)))


@query("w08_pnl", OBS + """, b AS (SELECT o.symbol, o.seq, o.mid_raw, f.s * f.size AS q, f.s * f.size * f.px_raw AS paid FROM obs o LEFT JOIN fills f USING (symbol, seq)),
e AS (SELECT symbol, seq, coalesce(sum(q) OVER w, 0) * mid_raw - coalesce(sum(paid) OVER w, 0) AS equity FROM b WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, seq, equity, equity - coalesce(lag(equity) OVER (PARTITION BY symbol ORDER BY seq), 0) AS step, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - equity AS drawdown FROM e""")
def w08(spark, sf_dir):
    obs = tables.observations(spark, sf_dir)
    return series.profit(obs, tables.fills(obs))


RESOLVED = OBS + f""", e AS (SELECT symbol, last(mid_raw ORDER BY ts_us, seq) AS final FROM obs GROUP BY symbol),
r AS (SELECT f.symbol, f.seq, f.s, f.size, f.px_raw, f.mid_raw, coalesce(o.mid_raw, e.final) AS mid_h FROM fills f ASOF LEFT JOIN obs o ON o.symbol = f.symbol AND f.ts_us + {HORIZON_US} <= o.ts_us JOIN e ON e.symbol = f.symbol),
t AS (SELECT *, 2 * s * (mid_raw - px_raw) AS effective, s * (mid_h - mid_raw) AS markout, 2 * s * (mid_raw - px_raw) - 2 * s * (mid_h - mid_raw) AS realised, s * (mid_h - mid_raw) < 0 AS toxic FROM r)"""


def resolved(spark, sf_dir):
    obs = tables.observations(spark, sf_dir)
    return series.markouts(obs, tables.fills(obs), HORIZON_US)


@query("j05_markout", RESOLVED + " SELECT symbol, seq, mid_h, markout FROM t")
def j05(spark, sf_dir):
    return resolved(spark, sf_dir).select("symbol", "seq", "mid_h", "markout")


@query("t07_spreads", RESOLVED + " SELECT symbol, seq, effective, realised, toxic FROM t")
def t07(spark, sf_dir):
    return resolved(spark, sf_dir).select("symbol", "seq", "effective", "realised", "toxic")


@query("a08_toxicity", RESOLVED + " SELECT symbol, count(*) AS fills, count(*) FILTER (toxic) AS toxic, sum(markout) AS markout_sum, sum(effective) AS effective_sum, sum(realised) AS realised_sum, round(count(*) FILTER (toxic) / count(*), 6) AS toxicity_rate, round(2 * sum(markout) / count(*), 6) AS adverse_cost FROM t GROUP BY symbol")
def a08(spark, sf_dir):
    return series.toxicity(resolved(spark, sf_dir))


@query("t02_quote", SIGMA + ", h AS (SELECT symbol, seq, mid_raw, greatest(0.5 * (0.5 * 0.0025 * pow(round(sigma, 6) / 100, 2) * 250.0 + (1 / 0.0025) * ln(1 + 0.0025 / 1.5)), 1.0) AS w FROM s) SELECT symbol, seq, CAST(floor((mid_raw - 100 * w) / 100) AS BIGINT) AS bid_ticks, CAST(ceil((mid_raw + 100 * w) / 100) AS BIGINT) AS ask_ticks FROM h")
def t02(spark, sf_dir):
    return series.quotes(tables.observations(spark, sf_dir))


VALUES = "WITH v AS (SELECT CAST(floor(abs(value)) AS BIGINT) AS value FROM events)"


def values(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select(F.floor(F.abs("value")).cast("long").alias("value"))


@query("a05_histogram", VALUES + f" SELECT least(value // {WIDTH}, {BUCKETS}) AS bucket, count(*) AS n FROM v GROUP BY 1")
def a05(spark, sf_dir):
    return series.histogram(values(spark, sf_dir), WIDTH, BUCKETS)


@query("a06_percentile", VALUES + f", h AS (SELECT least(value // {WIDTH}, {BUCKETS}) AS b, count(*) AS n FROM v GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS below, sum(n) OVER () AS total FROM h) SELECT p, CAST(least((min(b) + 1) * {WIDTH}, {WIDTH * BUCKETS}) AS BIGINT) AS value FROM c, (SELECT CAST(unnest({POINTS}) AS DOUBLE) AS p) q WHERE below >= greatest(floor(total * p + 0.5), 1) GROUP BY p")
def a06(spark, sf_dir):
    return series.percentiles(values(spark, sf_dir), WIDTH, BUCKETS, POINTS)


@query("a07_moments", VALUES + " SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM v")
def a07(spark, sf_dir):
    return values(spark, sf_dir).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


RISK = OBS + f""", o AS (SELECT symbol, seq, mid_raw AS price, seq % 401 AS qty, lag(mid_raw) OVER (PARTITION BY symbol ORDER BY seq) AS reference, seq % 1000 >= 990 AS kill FROM obs),
p AS (SELECT *, coalesce(sum(qty) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 60000 AS held FROM o),
v AS (SELECT symbol, seq, price * qty AS notional, CASE WHEN kill THEN 'kill_switch' WHEN qty = 0 THEN 'order_notional' WHEN reference IS NULL THEN 'no_reference_price' WHEN abs(price - reference) > {risk.LIMITS['band']} THEN 'price_band' WHEN price * qty > {risk.LIMITS['order_notional']} THEN 'order_notional' WHEN held + qty > {risk.LIMITS['position']} THEN 'position_limit' ELSE 'ok' END AS status FROM p)"""


def risk_orders(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("seq")
    before = F.sum(F.col("seq") % 401).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return tables.observations(spark, sf_dir).select("symbol", "seq", "ts_us", F.col("mid_raw").alias("price"), (F.col("seq") % 401).alias("qty"), F.lag("mid_raw").over(w).alias("reference"), (F.col("seq") % 1000 >= 990).alias("kill"), (F.coalesce(before, F.lit(0)) % 60000).alias("held"))


@query("r01_verdicts", RISK + " SELECT symbol, seq, status FROM v")
def r01(spark, sf_dir):
    return risk.verdicts(risk_orders(spark, sf_dir)).select("symbol", "seq", "status")


@query("r03_notional", RISK + " SELECT symbol, seq, notional FROM v")
def r03(spark, sf_dir):
    return risk.verdicts(risk_orders(spark, sf_dir)).select("symbol", "seq", "notional")


@query("a09_risk_counts", RISK + " SELECT status, count(*) AS n FROM v GROUP BY status")
def a09(spark, sf_dir):
    return risk.verdicts(risk_orders(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query("r04_token_bucket", steps.BUCKET)
def r04(spark, sf_dir):
    return risk.token_bucket(risk_orders(spark, sf_dir), rate=1)


STATES = list(risk.NEXT_STATES)
LEGAL = ", ".join(f"('{a}', '{b}')" for a, x in risk.NEXT_STATES.items() for b in x)


@query("m01_transition_audit", f"WITH s AS (SELECT user_id AS key, event_id AS seq, CASE event_id % 5 {' '.join(f'WHEN {i} THEN {chr(39)}{s}{chr(39)}' for i, s in enumerate(STATES))} END AS state FROM events), p AS (SELECT lag(state) OVER (PARTITION BY key ORDER BY seq) AS from_state, state AS to_state FROM s), legal(from_state, to_state) AS (VALUES {LEGAL}) SELECT p.from_state, p.to_state, l.from_state IS NOT NULL AS legal, count(*) AS n FROM p LEFT JOIN legal l USING (from_state, to_state) WHERE p.from_state IS NOT NULL GROUP BY 1, 2, 3")
def m01(spark, sf_dir):
    state = F.element_at(F.array(*(F.lit(s) for s in STATES)), (F.col("event_id") % 5).cast("int") + 1)
    return risk.transitions(tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), state.alias("state")))


#: Sums, which DuckDB gives as HUGEINT where Spark has BIGINT.
SUMS = {
    "o03_size_at": ["agg_size"],
    "o04_side_totals": ["total_size"],
    "o05_levels": ["agg_size"],
    "o05_topk_levels": ["agg_size"],
    "o07_queue_position": ["shares_ahead"],
    "a03_rollup": ["total_size"],
    "p09_recovery": ["agg_size"],
    "s04_walk": ["bad", "shares", "ids"],
    "q03_sequence_totals": ["missing"],
    "w07_position": ["position", "cash"],
    "w08_pnl": ["equity", "step", "drawdown"],
    "a08_toxicity": ["markout_sum", "effective_sum", "realised_sum"],
}
for _name, _columns in SUMS.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]}) AS answer"
