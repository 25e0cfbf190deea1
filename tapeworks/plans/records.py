"""Queries of binary and text records: packets, traces, dumps and write-ahead logs."""

from pyspark.sql import functions as F

from ..operators import sequence
from ..sources import log, shared, tables, trace, wire
from .queries import FOLD, live, query

SESSION = "row_number() OVER (PARTITION BY order_id % 64 ORDER BY ts, kind, line, part, supp, order_id)"
NUMBERED = f"WITH m AS ({tables.MESSAGES_DUCK}), n AS (SELECT *, order_id % 64 AS session, {SESSION} AS seq FROM m)"


def frames(spark, sf_dir):
    """(session, seq, frame): all messages as frames of 64 sessions."""
    return wire.encode(tables.in_sessions(tables.messages(spark, sf_dir)))


def walked(spark, sf_dir):
    return wire.walk(wire.packets(frames(spark, sf_dir)).select(F.col("session").alias("source"), "content"))


@query("s05_packets", NUMBERED + " SELECT 'S' || session AS session, CAST(min(seq) AS BIGINT) AS first, count(*) AS n FROM n GROUP BY session, (seq - 1) // 64")
def s05(spark, sf_dir):
    return wire.packet_list(walked(spark, sf_dir).withColumn("packet_no", F.expr("(cast(seq AS bigint) - 1) DIV 64"))).select("session", "first", "n")


LINE = "concat_ws(' ', CAST(seq - 1 AS VARCHAR), 'D', {tag}, {len}, '0000', '0000', '000000000000', lpad(lower(to_hex(order_id)), 16, '0'){rest})"
LINES = {
    "A": ("'41'", "'0036'", ", lower(hex(side)), lpad(lower(to_hex(qty)), 8, '0'), lower(hex(rpad(symbol, 8, ' '))), lpad(lower(to_hex(px_raw)), 8, '0')"),
    "E": ("'45'", "'0031'", ", lpad(lower(to_hex(qty)), 8, '0'), '0000000000000000'"),
    "C": ("'43'", "'0036'", ", lpad(lower(to_hex(qty)), 8, '0'), '0000000000000000', '59', '00000000'"),
    "X": ("'58'", "'0023'", ", lpad(lower(to_hex(qty)), 8, '0')"),
    "D": ("'44'", "'0019'", ""),
}
TRACE = NUMBERED + ", t AS (SELECT session, seq - 1 AS index, CASE tag " + " ".join(f"WHEN '{t}' THEN {LINE.format(tag=a, len=b, rest=c)}" for t, (a, b, c) in LINES.items()) + " END AS line FROM n)"


def traced(spark, sf_dir):
    f = frames(spark, sf_dir).select("session", "seq", "frame", F.length("frame").alias("declared"), F.lit(True).alias("complete"))
    return trace.lines(f, ["session"], F.col("seq") - 1)


@query("d10_trace", TRACE + " SELECT session, index, line FROM t")
def d10(spark, sf_dir):
    return traced(spark, sf_dir)


@query("d11_trace_checks", TRACE + " SELECT chr(CAST(('0x' || line[length(CAST(index AS VARCHAR)) + 4 : length(CAST(index AS VARCHAR)) + 5]) AS INTEGER)) AS tag, index % 50 <> 7 AS ok, count(*) AS n FROM t GROUP BY 1, 2")
def d11(spark, sf_dir):
    """Traces with a digit cut off every fiftieth line, written as text, read back and checked."""
    t = traced(spark, sf_dir)
    cut = t.withColumn("line", F.when(F.col("index") % 50 == 7, F.regexp_replace("line", ".$", "")).otherwise(F.col("line")))
    to = shared.fresh(spark, "trace")
    trace.write(cut.select("session", "index", "line"), to)
    return trace.read(spark, to).groupBy("tag", "ok").agg(F.count("*").alias("n"))


@query("j08_trace_diff", TRACE + " SELECT session, index, line AS line_one, CASE WHEN index % 90 = 11 THEN NULL ELSE replace(line, ' D ', ' M ') END AS line_other, CAST(CASE WHEN index % 90 = 11 THEN 0 ELSE 1 END AS BIGINT) AS word FROM t WHERE index % 90 = 11 OR index % 70 = 5")
def j08(spark, sf_dir):
    """Traces against themselves with some lines lost and some statuses changed."""
    t = shared.cut(traced(spark, sf_dir))  # both sides come from it
    other = t.where("index % 90 <> 11").withColumn("line", F.when(F.col("index") % 70 == 5, F.replace("line", F.lit(" D "), F.lit(" M "))).otherwise(F.col("line")))
    return trace.compare(t, other, ["session", "index"])


@query("k06_hex_lines", NUMBERED + ", p AS (SELECT session, (seq - 1) // 64 AS packet, sum(2 + CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 ELSE 19 END) + 20 AS size FROM n GROUP BY 1, 2) SELECT session, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum((size + 63) // 64) AS BIGINT) AS lines FROM p GROUP BY session")
def k06(spark, sf_dir):
    p = wire.packets(frames(spark, sf_dir)).select(F.concat_ws("-", "session", "packet_no").alias("source"), "content")
    text = trace.hex_lines(p)
    return text.groupBy(F.split("source", "-")[0].cast("long").alias("session")).agg(F.count_if(F.col("n") == 0).alias("packets"), (F.sum(F.length("line")) / 2).cast("long").alias("bytes"), F.count("*").alias("lines"))


@query("d17_inspect", f"SELECT tag, count(*) AS n, CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 ELSE 19 END AS last_length, CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 ELSE 19 END AS expected, 'ok' AS verdict FROM ({tables.MESSAGES_DUCK}) m GROUP BY tag")
def d17(spark, sf_dir):
    return trace.inspected(frames(spark, sf_dir))


def word(x):
    return f"lpad(lower(to_hex({x})), 16, '0')"


BEST = "CASE WHEN side = 'B' THEN -px_raw ELSE px_raw END"
DUMP = FOLD + f""", q AS (SELECT symbol, side, px_raw, row_number() OVER (PARTITION BY symbol, side, px_raw ORDER BY ts, order_id) - 1 AS position, order_id, size, state FROM live),
d AS (SELECT symbol, side, px_raw, position, concat_ws(' ', 'O', CASE side WHEN 'B' THEN 'B' ELSE 'A' END, {word('order_id')}, {word('px_raw')}, {word('size')}, CAST(state AS VARCHAR), CAST(position AS VARCHAR)) AS t FROM q
UNION ALL SELECT symbol, side, px_raw, -1, concat_ws(' ', 'L', CASE side WHEN 'B' THEN 'B' ELSE 'A' END, {word('px_raw')}, CAST(count(*) AS VARCHAR), {word('CAST(sum(size) AS BIGINT)')}) FROM live GROUP BY symbol, side, px_raw),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY side, {BEST}, position) - 1 AS n FROM d)
SELECT symbol, n, concat_ws(' ', CAST(n AS VARCHAR), t) AS line FROM n"""


@query("k07_dump", DUMP)
def k07(spark, sf_dir):
    return trace.dump(live(spark, sf_dir))


@query("j09_dump_diff", f"WITH a AS ({DUMP}) SELECT symbol, n, line AS line_one, CASE WHEN n % 40 = 3 THEN NULL ELSE line || '0' END AS line_other, CASE WHEN n % 40 = 3 THEN 0 ELSE len(string_split(line, ' ')) - 1 END AS word FROM a WHERE n % 40 = 3 OR n % 30 = 1")
def j09(spark, sf_dir):
    """Dumps against themselves with some lines lost and some values changed."""
    d = trace.dump(live(spark, sf_dir))
    other = d.where("n % 40 <> 3").withColumn("line", F.when(F.col("n") % 30 == 1, F.concat("line", F.lit("0"))).otherwise(F.col("line")))
    return trace.compare(d, other, ["symbol", "n"])


@query("p07_log", NUMBERED + ", r AS (SELECT * FROM n WHERE seq <> 50 UNION ALL SELECT * FROM n WHERE seq % 9 = 0 AND seq <> 50) SELECT session AS source, CASE WHEN seq > 50 THEN 'gap' WHEN c = 1 THEN 'ok' ELSE 'duplicate' END AS status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY seq) AS c FROM r) x GROUP BY 1, 2")
def p07(spark, sf_dir):
    """Each session's log with every ninth record written twice and the fiftieth lost, and read again."""
    f = frames(spark, sf_dir).where("seq <> 50").select(F.col("session").alias("source"), "seq", "frame")
    r = log.append(f, ["source"])
    n = 2 * F.col("seq")
    twice = r.withColumn("n", F.explode(F.when(F.col("seq") % 9 == 0, F.array(n, n + 1)).otherwise(F.array(n))))
    return log.read(log.segments(twice, 256)).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("p08_resume", NUMBERED + " SELECT session AS source, CASE WHEN seq <= 40 THEN 'duplicate' ELSE 'ok' END AS status, count(*) AS n FROM n GROUP BY 1, 2")
def p08(spark, sf_dir):
    r = log.append(frames(spark, sf_dir).select(F.col("session").alias("source"), "seq", "frame"), ["source"])
    return log.read(log.segments(r.withColumn("n", F.col("seq")), 256), applied=40).groupBy("source", "status").agg(F.count("*").alias("n"))


PACKETS = """WITH RECURSIVE p AS (SELECT user_id % 4 AS session, event_id AS arrival, event_id - event_id % 7 + 2 * (event_id // 400) AS first, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 + event_id % 6 END AS n, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS rn FROM events),
e AS (SELECT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS following, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS expected FROM p WHERE rn = 1
  UNION ALL SELECT p.session, p.rn, CASE WHEN p.n > 0 AND p.first >= coalesce(e.following, p.first) THEN p.first + p.n ELSE e.following END, p.arrival, p.first, p.n, coalesce(e.following, p.first) FROM e JOIN p ON p.session = e.session AND p.rn = e.rn + 1)"""


@query("q02_packet_state", PACKETS + " SELECT session, arrival, first, n, expected, CASE WHEN first = expected THEN 'ok' WHEN first > expected THEN 'gap' ELSE 'duplicate' END AS state, greatest(first - expected, 0) AS missing FROM e WHERE rn > 0")
def q02(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    n = F.when(F.col("event_id") % 11 == 0, F.lit(0).cast("long")).otherwise(1 + F.col("event_id") % 6)
    return sequence.audited_packets(e.select((F.col("user_id") % 4).alias("session"), F.col("event_id").alias("arrival"), F.expr("event_id - event_id % 7 + 2 * (event_id DIV 400)").alias("first"), n.alias("n")))
