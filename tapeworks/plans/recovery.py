"""Queries of captures in files, cut and raw frames, replaces on the wire, snapshots, dumps read back, and checksums over time."""

from pyspark.sql import functions as F

from ..operators import book, replaces, risk, sequence
from ..sources import shared, snapshots, tables, trace, wire
from . import steps
from .queries import BETTER, FOLD, HASH_BYTES, live, query
from .records import NUMBERED, frames

SIZE = "CASE tag WHEN 'A' THEN 36 WHEN 'E' THEN 31 WHEN 'C' THEN 36 WHEN 'X' THEN 23 WHEN 'U' THEN 35 ELSE 19 END"
SPLIT = "1996-01-01"


def sized(rows: str, keys: str = "") -> str:
    """Checksums for DuckDB of rows (symbol, side, order_id, px_raw, size, state, ts)."""
    numbers = "flatten(list([order_id, px_raw, size, CAST(state AS BIGINT)] ORDER BY side, rank, ts, order_id))"
    return f"SELECT {keys}symbol, {HASH_BYTES.format(s=numbers)} AS h FROM (SELECT *, {BETTER} AS rank FROM {rows}) r GROUP BY {keys}symbol"


def hexed(h: str) -> str:
    """Sixteen hex digits of an unsigned number."""
    return f"lower(lpad(to_hex(CAST({h} AS UBIGINT)), 16, '0'))"


@query("o08_checksum", f"{FOLD}, s AS ({sized('live')}) SELECT symbol, {hexed('h')} AS checksum FROM s")
def o08(spark, sf_dir):
    return book.checksums(live(spark, sf_dir))


@query("o09_combined_checksum", f"{FOLD}, s AS ({sized('live')}) SELECT {hexed('bit_xor(CAST(h AS UBIGINT))')} AS checksum FROM s")
def o09(spark, sf_dir):
    return book.combined(book.checksums(live(spark, sf_dir)))


YEARS = ("1993-01-01", "1999-01-01")
THEN = f"""{FOLD}, k AS (SELECT unnest(generate_series(TIMESTAMP '{YEARS[0]}', TIMESTAMP '{YEARS[1]}', INTERVAL 1 YEAR)) AS mark),
held AS (SELECT k.mark, f.symbol, f.side, f.order_id, f.px_raw, f.rem AS size, f.state, f.ts FROM (SELECT *, lead(told) OVER (PARTITION BY order_id ORDER BY rn) AS until FROM fold) f JOIN k ON f.told < k.mark AND (f.until IS NULL OR f.until >= k.mark) WHERE f.live),
s AS ({sized('held', 'mark, ')})"""


@query("o09_checkpoints", f"{THEN} SELECT symbol, {hexed('bit_xor(CAST(h AS UBIGINT))')} AS checksum, count(*) AS checkpoints FROM s GROUP BY symbol")
def o09_checkpoints(spark, sf_dir):
    """The checksums of each symbol's book at the beginning of each year, combined."""
    then = book.lived(tables.messages(spark, sf_dir), *YEARS, "year")
    sums = shared.cut(book.checksums(then, ("symbol", "at")))
    return book.combined(sums, ("symbol",)).join(sums.groupBy("symbol").agg(F.count("*").alias("checkpoints")), "symbol")


SIDES = ", ".join(f"coalesce(CAST({x} FILTER (side = '{s}') AS BIGINT), 0)" for x in ("count(DISTINCT px_raw)", "count(*)", "sum(size)") for s in "BS")
PRINTS = f"{FOLD}, f AS (SELECT symbol, {HASH_BYTES.format(s=f'[{SIDES}]')} AS h FROM live GROUP BY symbol)"


@query("o10_book_fingerprint", f"{PRINTS} SELECT symbol, {hexed('h')} AS fingerprint FROM f")
def o10_book(spark, sf_dir):
    return book.fingerprints(live(spark, sf_dir))


LADDER = f"""{FOLD}, l AS (SELECT symbol, side, px_raw, CAST(sum(size) AS BIGINT) AS shares, count(*) AS orders FROM live GROUP BY symbol, side, px_raw),
t AS (SELECT symbol, {", ".join(f"coalesce(CAST({x} FILTER (side = '{s}') AS BIGINT), 0) AS {n}_{s}" for n, x in (("l", "count(*)"), ("o", "sum(orders)"), ("q", "sum(shares)")) for s in "BS")},
  {", ".join(f"coalesce(flatten(list([px_raw, shares, orders] ORDER BY {BETTER}) FILTER (side = '{s}')), []) AS a_{s}" for s in "BS")} FROM l GROUP BY symbol),
f AS (SELECT symbol, {HASH_BYTES.format(s="flatten([[l_B, l_S, o_B, o_S, q_B, q_S, l_B], a_B, [l_S], a_S])")} AS h FROM t)"""


@query("o10_ladder_fingerprint", f"{LADDER} SELECT symbol, {hexed('h')} AS fingerprint FROM f")
def o10_ladder(spark, sf_dir):
    return book.fingerprints(live(spark, sf_dir), ladder=True)


SYMBOL_BYTES = "list_transform(string_split(symbol, ''), lambda c: CAST(ascii(c) AS HUGEINT))"
NUMBER_BYTES = "list_transform(range(8), lambda i: (CAST({x} AS HUGEINT) // CAST(pow(256, i) AS HUGEINT)) % 256)"
CANONICAL = f"""{PRINTS}, b AS (SELECT count(*) AS books, list_concat({NUMBER_BYTES.format(x='count(*)')}, flatten(list(list_concat({SYMBOL_BYTES}, {NUMBER_BYTES.format(x='h')}) ORDER BY symbol))) AS bytes FROM f)
SELECT books, {hexed("list_reduce(bytes, lambda v, x: (xor(v, x) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT))")} AS fingerprint FROM b"""


@query("o11_canonical_fingerprint", CANONICAL)
def o11(spark, sf_dir):
    return book.canonical(book.fingerprints(live(spark, sf_dir)))


@query("s01_capture_files", f"SELECT tag, count(*) AS n, CAST(sum({SIZE}) AS BIGINT) AS bytes, CAST(sum(qty) FILTER (tag <> 'D') AS BIGINT) AS shares, CAST(sum(order_id) AS BIGINT) AS ids FROM ({tables.MESSAGES_DUCK}) m GROUP BY tag")
def s01(spark, sf_dir):
    """Each session's packets in capture files, the next one begun after every 2,048 packets; read, walked and decoded."""
    p = wire.packets(frames(spark, sf_dir))
    files = p.groupBy("session", F.expr("packet_no DIV 2048").alias("part")).agg(F.expr("listagg(content) WITHIN GROUP (ORDER BY packet_no)").alias("content"))
    to = shared.fresh(spark, "captures")
    wire.write_captures(files.select((F.col("session") * 1_000_000 + F.col("part")).alias("source"), "content"), to)
    d = wire.decode(wire.walk(wire.captures(spark, to))).where("status = 'ok'")
    return d.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.length("frame")).alias("bytes"), F.sum("qty").cast("long").alias("shares"), F.sum("order_id").cast("long").alias("ids"))


PACKED = f"{NUMBERED}, p AS (SELECT session, (seq - 1) // 64 AS packet, count(*) AS n, arg_max(tag, seq) AS last FROM n GROUP BY 1, 2)"


@query("s06_cut_frames", f"{PACKED} SELECT session, count(*) AS packets, CAST(sum(n - 1) AS BIGINT) AS whole, count(*) AS cut, CAST(sum({SIZE.replace('tag', 'last', 1)} - 3) AS BIGINT) AS cut_bytes FROM p GROUP BY session")
def s06(spark, sf_dir):
    """Every packet with its last three bytes cut off: what is left of it, and of its last frame."""
    p = wire.packets(frames(spark, sf_dir)).select(F.col("session").alias("source"), F.expr("substring(content, 1, length(content) - 3)").alias("content"))
    w = wire.walk(p, emit_partial=True)
    cut = ~F.col("complete")
    return w.groupBy(F.col("source").alias("session")).agg(F.count_if(F.col("idx") == 0).alias("packets"), F.count_if("complete").alias("whole"), F.count_if(cut).alias("cut"), F.sum(F.when(cut, F.length("frame")).cast("long")).alias("cut_bytes"))


def raw(spark, sf_dir):
    """(source, content): each session's frames, one after the other, 256 to a content."""
    f = frames(spark, sf_dir).withColumn("part", F.expr("(seq - 1) DIV 256"))
    g = f.select("session", "part", "seq", wire.prefixed(F.col("frame")).alias("block")).groupBy("session", "part").agg(F.expr("listagg(block) WITHIN GROUP (ORDER BY seq)").alias("content"))
    return g.select((F.col("session") * 1_000_000 + F.col("part")).alias("source"), "content")


@query("s07_raw_frames", f"{NUMBERED} SELECT CAST(session AS BIGINT) AS session, count(*) AS frames, CAST(sum({SIZE}) AS BIGINT) AS bytes, true AS whole FROM n GROUP BY session")
def s07(spark, sf_dir):
    w = wire.walk_raw(raw(spark, sf_dir))
    return w.groupBy(F.expr("source DIV 1000000").alias("session")).agg(F.count("*").alias("frames"), F.sum("declared").alias("bytes"), F.bool_and("complete").alias("whole"))


REPACKED = f"""{NUMBERED}, r AS (SELECT session * 1000000 + (seq - 1) // 256 AS source, (seq - 1) % 256 AS idx, tag, {SIZE} + 2 AS size FROM n),
b AS (SELECT *, min(idx) FILTER (tag = 'A') OVER (PARTITION BY source) AS start FROM r), k AS (SELECT *, (idx - start) // 64 AS packet_no FROM b WHERE idx >= start),
s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY idx) - size AS past FROM k), q AS (SELECT *, min(past) OVER (PARTITION BY source, packet_no) + 20 * packet_no + size <= 5000 AS fits FROM s),
z AS (SELECT *, bool_and(fits) OVER (PARTITION BY source ORDER BY idx) AS good FROM q)
SELECT CAST(source AS BIGINT) AS source, CAST(packet_no AS BIGINT) AS packet_no, CAST(min(idx) AS BIGINT) AS first, count(*) AS n, CAST(sum(size) + 20 AS BIGINT) AS bytes FROM z WHERE good GROUP BY source, packet_no"""


@query("k04_repacked", REPACKED)
def k04(spark, sf_dir):
    """Raw frames as packets from the first add on, of some 5,000 bytes a source."""
    p = wire.repacked(wire.walk_raw(raw(spark, sf_dir)), "SAMPLE0000", "A", 5000)
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("long")
    return p.select("source", "packet_no", number(11, 8).alias("first"), number(19, 2).alias("n"), F.length("content").cast("long").alias("bytes"))


@query("s14_receive_time", "SELECT event_id, CASE WHEN event_id % 10 < 8 THEN epoch_us(ts) * 1000 + event_id % 1000 END AS ns FROM events")
def s14(spark, sf_dir):
    """Receive times as 16 bytes of seconds and nanoseconds; some have nanoseconds out of range, some are cut."""
    e = tables.read(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    little = lambda v: F.unhex(wire.turned(F.lpad(F.hex(v), 16, "0")))
    nanos = F.when(F.col("event_id") % 10 == 8, F.lit(10**9)).otherwise(F.col("us") % 1_000_000 * 1000 + F.col("event_id") % 1000)
    whole = F.concat(little(F.expr("us DIV 1000000")), little(nanos))
    payload = F.when(F.col("event_id") % 10 == 9, F.substring(whole, 1, 15)).otherwise(whole)
    return e.select("event_id", wire.receive_time(payload).cast("long").alias("ns"))


WITH_U = f"SELECT ts, kind, order_id, tag, symbol, side, qty, px_raw, line, part, supp, NULL AS new_id FROM ({tables.MESSAGES_DUCK}) m UNION ALL {tables.REPLACES_DUCK}"


@query("k01_replace_frames", f"SELECT tag, count(*) AS n, CAST(sum(order_id) AS BIGINT) AS ids, CAST(sum(new_id) AS BIGINT) AS new_ids, CAST(sum(qty) FILTER (tag <> 'D') AS BIGINT) AS shares, CAST(sum(px_raw) AS BIGINT) AS prices, 0 AS bad FROM ({WITH_U}) m GROUP BY tag")
def k01(spark, sf_dir):
    """All messages, replaces too, encoded and decoded again."""
    m = tables.with_replaces(spark, sf_dir)
    d = wire.decode(wire.encode(m).select("frame"))
    price = F.when(F.col("tag").isin("A", "U"), F.col("px_raw"))
    total = lambda c: F.sum(c).cast("long")
    return d.groupBy("tag").agg(F.count("*").alias("n"), total("order_id").alias("ids"), total("new_id").alias("new_ids"), total("qty").alias("shares"), total(price).alias("prices"), F.count_if(F.col("status") != "ok").cast("int").alias("bad"))


@query("d13_fits", f"SELECT tag, qty % 7 = 0 AND tag <> 'D' AS wide, count(*) AS n, count(*) FILTER (NOT (qty % 7 = 0 AND tag <> 'D')) AS encoded FROM ({tables.MESSAGES_DUCK}) m GROUP BY 1, 2")
def d13(spark, sf_dir):
    """Messages of which some have more shares than four bytes hold: those get no frame."""
    m = tables.messages(spark, sf_dir).withColumn("wide", (F.col("qty") % 7 == 0) & (F.col("tag") != "D"))
    e = wire.encode(m.withColumn("qty", F.when(F.col("wide"), F.col("qty") + 2**32).otherwise(F.col("qty"))))
    return e.groupBy("tag", "wide").agg(F.count("*").alias("n"), F.count_if("fits").alias("encoded"))


@query("b06_dispatch", f"{FOLD} SELECT tag, outcome, count(*) AS n FROM fold WHERE rn > 0 GROUP BY ALL UNION ALL SELECT ['B', 'P', 'Q', 'S'][1 + event_id % 4], 'ok', count(*) FROM events GROUP BY 1, 2")
def b06(spark, sf_dir):
    """Order messages, and messages that no book changes by: broken trades, trades, crosses and system events."""
    m = tables.messages(spark, sf_dir)
    e = tables.read(spark, sf_dir, "events")
    bare = {c: F.lit(None).cast(t) for c, t in m.dtypes}
    given = {"ts": F.col("ts"), "kind": F.lit(3), "order_id": F.col("event_id"), "tag": F.element_at(F.array(*map(F.lit, "BPQS")), (1 + F.col("event_id") % 4).cast("int")), "qty": F.lit(5).cast("long"), "line": F.lit(0), "part": F.lit(0).cast("long"), "supp": F.lit(0).cast("long")}
    other = e.select(*({**bare, **given}[c].cast(t).alias(c) for c, t in m.dtypes))
    return book.journal(m.unionByName(other)).groupBy("tag", "outcome").agg(F.count("*").alias("n"))


@query("b07_restored", FOLD + " SELECT order_id, symbol, side, px_raw, size, state FROM live")
def b07(spark, sf_dir):
    """A snapshot written, read and restored, and the messages after it: all orders with their states."""
    m = tables.messages(spark, sf_dir)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    to = shared.fresh(spark, "snapshot")
    snapshots.write(book.live_orders(m.where(F.col("ts") < at)), to)
    return snapshots.restored(snapshots.read(spark, to), m.where(F.col("ts") >= at)).drop("ts")


EARLY = f"{FOLD}, early AS (SELECT order_id, symbol, side, px_raw, rem AS size, state, ts FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY rn DESC) AS back FROM fold WHERE told IS NULL OR told < TIMESTAMP '{SPLIT}') x WHERE back = 1 AND live)"


@query("k09_snapshot", f"{EARLY}, s AS ({sized('early')}) SELECT symbol, {hexed('h')} AS checksum, true AS ok FROM s")
def k09(spark, sf_dir):
    """A snapshot's checksums, against those of the book that is restored from it."""
    m = tables.messages(spark, sf_dir).where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    to = shared.fresh(spark, "snapshot")
    snapshots.write(book.live_orders(m), to)
    return snapshots.verified(spark, to, snapshots.restored(snapshots.read(spark, to), m.limit(0)))


@query("s17_dump_read", f"{FOLD}, s AS ({sized('live')}), c AS (SELECT symbol, count(*) AS orders, count(DISTINCT (side, px_raw)) AS levels FROM live GROUP BY symbol) SELECT symbol, {hexed('h')} AS checksum, levels, orders, true AS ok FROM s JOIN c USING (symbol)")
def s17(spark, sf_dir):
    """Book dumps written as text and read back: whether the orders that were read have the checksum that was written."""
    to = shared.fresh(spark, "dump")
    trace.write_dump(live(spark, sf_dir), to)
    levels, orders, sums = trace.read_dump(spark, to)
    now = book.checksums(orders.withColumn("ts", F.col("n"))).withColumnRenamed("checksum", "now")
    counts = orders.groupBy("symbol").agg(F.count("*").alias("orders")).join(levels.groupBy("symbol").agg(F.count("*").alias("levels")), "symbol")
    return sums.join(now, "symbol").join(counts, "symbol").select("symbol", "checksum", "levels", "orders", (F.col("checksum") == F.col("now")).alias("ok"))


RESYNC = f"""WITH {tables.TRANSMISSIONS_DUCK}, r AS (SELECT *, arrival % 1000 = 4 AS resync FROM tr),
p AS (SELECT *, {{part}} AS part FROM r), e AS (SELECT *, coalesce(max(observed + 1) OVER (PARTITION BY session, part ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), observed) AS expected FROM p)
SELECT session, count(*) FILTER (resync) AS resyncs, count(*) FILTER (observed >= expected) AS accepted, CAST(sum(greatest(observed - expected, 0)) AS BIGINT) AS missing, count(*) FILTER (observed > expected) AS gaps, count(*) FILTER (observed < expected) AS rejects,
  sum(greatest(observed - expected, 0)) = 0 AND count(*) FILTER (observed < expected) = 0 AS clean FROM e GROUP BY session"""


def marked(spark, sf_dir):
    return tables.transmissions(spark, sf_dir).withColumn("resync", F.col("arrival") % 1000 == 4)


@query("q04_resync", RESYNC.format(part="0"))
def q04(spark, sf_dir):
    return sequence.resynced(marked(spark, sf_dir))


@query("q04_rebased", RESYNC.format(part="count(*) FILTER (resync) OVER (PARTITION BY session ORDER BY arrival)"))
def q04_rebased(spark, sf_dir):
    return sequence.resynced(marked(spark, sf_dir), rebase=True)


ALL_STATES = [*risk.NEXT_STATES, *risk.FINAL_STATES]
LEGAL = ", ".join(f"('{a}', '{b}')" for a, x in risk.NEXT_STATES.items() for b in x)
STATE = "[" + ", ".join(f"'{x}'" for x in ALL_STATES) + "][1 + event_id * 7 // 3 % 8]"


@query("m01_all_states", f"WITH s AS (SELECT user_id AS key, event_id AS seq, {STATE} AS state FROM events), p AS (SELECT lag(state) OVER (PARTITION BY key ORDER BY seq) AS from_state, state AS to_state FROM s), legal(from_state, to_state) AS (VALUES {LEGAL}) SELECT p.from_state, p.to_state, l.from_state IS NOT NULL AS legal, count(*) AS n FROM p LEFT JOIN legal l USING (from_state, to_state) WHERE p.from_state IS NOT NULL GROUP BY 1, 2, 3")
def m01(spark, sf_dir):
    """Transitions over all eight states, those in which an order is over too."""
    state = F.element_at(F.array(*map(F.lit, ALL_STATES)), (1 + F.expr("event_id * 7 DIV 3 % 8")).cast("int"))
    return risk.transitions(tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), state.alias("state")))


ORDERS = "SELECT order_id, symbol, side, px_raw, size, state FROM"


@query("j10_orders_diff", f"{EARLY} SELECT *, 'one' AS have FROM ({ORDERS} early EXCEPT ALL {ORDERS} live) a UNION ALL SELECT *, 'other' FROM ({ORDERS} live EXCEPT ALL {ORDERS} early) b")
def j10_orders(spark, sf_dir):
    m = tables.messages(spark, sf_dir)
    early = m.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    return book.differences(book.live_orders(early).drop("ts"), book.live_orders(m).drop("ts"))


TOP = "SELECT symbol, max(CASE WHEN side = 'B' THEN px_raw END) AS best_bid, min(CASE WHEN side = 'S' THEN px_raw END) AS best_ask FROM {} GROUP BY symbol"


@query("j10_bbo_diff", f"{EARLY}, a AS ({TOP.format('early')}), b AS ({TOP.format('(SELECT * FROM live WHERE order_id % 97 > 3)')}) SELECT *, 'one' AS have FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x UNION ALL SELECT *, 'other' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y")
def j10_bbo(spark, sf_dir):
    """Tops of an early book against those of the last one, which lacks some orders."""
    m = tables.messages(spark, sf_dir)
    early = m.where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    return book.differences(book.bbo(book.live_orders(early)), book.bbo(book.live_orders(m).where("order_id % 97 > 3")))


@query("b05_replace", steps.replaced(FOLD))
def b05(spark, sf_dir):
    return replaces.live_orders(tables.with_replaces(spark, sf_dir))


TOPS = FOLD + """, done AS (SELECT f.order_id, f.rn, f.symbol, f.side, f.px_raw, f.live, f.tag, o.ts, o.kind, o.line, o.part, o.supp FROM fold f JOIN ord o USING (order_id, rn) WHERE f.outcome = 'ok'),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, kind, order_id, line, part, supp) - 1 AS n FROM done),
held AS (SELECT symbol, side, px_raw, live, n AS a, lead(n) OVER (PARTITION BY order_id ORDER BY rn) AS b FROM num),
bid AS (SELECT x.symbol, x.n, max(h.px_raw) AS px FROM num x JOIN held h ON h.symbol = x.symbol AND h.live AND h.side = 'B' AND h.a <= x.n AND (h.b IS NULL OR h.b > x.n) GROUP BY 1, 2),
ask AS (SELECT x.symbol, x.n, min(h.px_raw) AS px FROM num x JOIN held h ON h.symbol = x.symbol AND h.live AND h.side = 'S' AND h.a <= x.n AND (h.b IS NULL OR h.b > x.n) GROUP BY 1, 2)
SELECT num.symbol, num.n, num.ts, num.tag, bid.px AS best_bid, ask.px AS best_ask FROM num LEFT JOIN bid USING (symbol, n) LEFT JOIN ask USING (symbol, n)"""


@query("j06_book_asof", TOPS)
def j06(spark, sf_dir):
    """The top of each symbol's book after every message that changed it, and how many were there so far."""
    return book.tops(tables.messages(spark, sf_dir))


#: The fields of the messages that the tables give, and their bytes.
SPECS = {
    "A": [("order_id", 8), ("side", 1), ("qty", 4), ("stock", 8), ("px_raw", 4)],
    "E": [("order_id", 8), ("qty", 4), ("match", 8)],
    "C": [("order_id", 8), ("qty", 4), ("match", 8), ("printable", 1), ("px_raw", 4)],
    "X": [("order_id", 8), ("qty", 4)],
    "D": [("order_id", 8)],
}
TOLD = ", ".join(f"('{t}', {i}, '{n}', {b})" for t, x in SPECS.items() for i, (n, b) in enumerate([("locate", 2), ("tracking", 2), ("ts_ns", 6), *x]))


@query("d12_field_specs", f"WITH spec(tag, place, field, bytes) AS (VALUES {TOLD}), n AS (SELECT tag, count(*) AS n FROM ({tables.MESSAGES_DUCK}) m GROUP BY tag) SELECT tag, place, field, bytes, n, n * bytes AS total FROM spec JOIN n USING (tag)")
def d12(spark, sf_dir):
    """The fields of each message that there is, and how many bytes they take up in all."""
    n = tables.messages(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(trace.field_specs(spark)), "tag").select("tag", "place", "field", "bytes", "n", (F.col("n") * F.col("bytes")).alias("total"))
