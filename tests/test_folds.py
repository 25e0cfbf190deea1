"""Replaces, tops, records and folds, against naive models and cases worked by hand."""

import struct

from pyspark.sql import functions as F
from test_queries import naive_book

from tapeworks.functions import hashes, prices
from tapeworks.operators import book, folds, maker, manager, replaces, risk, routing, sequence, session
from tapeworks.plans import queries as plans
from tapeworks.sources import log, tables, trace, wire
from tapeworks.streaming import replay


def test_replaces_against_naive_book(spark, sf):
    messages = tables.with_replaces(spark, sf)
    orders = {}
    for m in sorted(messages.collect(), key=lambda m: (m.ts, m.kind, m.order_id, m.line, m.part, m.supp)):
        o = orders.get(m.order_id)
        new, held = (m.order_id, [m.symbol, m.side]) if m.tag == "A" else (m.new_id, o and o[:2])
        if m.tag == "U" and o:
            del orders[m.order_id]
        if m.tag == "A" or (m.tag == "U" and o):
            if new and new not in orders and m.qty:
                orders[new] = [*held, m.px_raw, m.qty, 0]
        elif o and m.tag == "D" or o and m.qty == o[3]:
            del orders[m.order_id]
        elif o and m.qty < o[3]:
            o[3] -= m.qty
            o[4] = 0 if m.tag == "X" else 1
    got = {r.order_id: [r.symbol, r.side, r.px_raw, r.size, r.state] for r in replaces.live_orders(messages).collect()}
    assert got == orders
    assert any(k > 10**12 for k in got)


def test_chains_join_whatever_connects(spark):
    edges = [(9, 8), (8, 7), (7, 1), (20, 21), (30, 21), (40, 40), (22, 30)]
    got = {r.order_id: r.chain for r in replaces.chains(spark.createDataFrame(edges, "order_id long, new_id long")).collect()}
    assert got == {1: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 22: 20, 30: 20, 40: 40}


def test_tops_and_months_against_naive_book(spark, sf):
    m = tables.messages(spark, sf)
    rows = sorted(m.collect(), key=lambda m: (m.ts, m.kind, m.order_id, m.line, m.part, m.supp))
    last = {(r.symbol): r for r in sorted(book.tops(m).collect(), key=lambda r: r.n)}
    end = book.bbo(book.live_orders(m)).collect()
    assert {r.symbol: (r.best_bid, r.best_ask) for r in end} == {s: (r.best_bid, r.best_ask) for s, r in last.items()}
    seen = {(r.symbol, r.month): (r.best_bid, r.best_ask, r.live_orders) for r in book.top_at(m, "1994-01-01", "1994-03-01").collect()}
    for month in sorted({k[1] for k in seen}):
        left = naive_book([x for x in rows if x.ts < month])
        for s in {v[0] for v in left.values()}:
            bids = [v[2] for v in left.values() if v[0] == s and v[1] == "B"]
            asks = [v[2] for v in left.values() if v[0] == s and v[1] == "S"]
            assert seen[s, month] == (max(bids, default=None), min(asks, default=None), len(bids) + len(asks))


def test_hash_of_text(spark):
    texts = ["", "a", "SYM00007", "é" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(hashes.as_hex(hashes.text_hash(F.col("t")))).collect()
    assert [r[0] for r in got] == [f"{hashes.fnv1a(t.encode()):016x}" for t in texts]


def test_standby_after_standby(spark):
    df = spark.createDataFrame([("x",)], "symbol string")
    at = lambda over, down, n=4: routing.routes(df, n, {"x": over}, down).first().shard
    assert (at(1, set()), at(1, {1}), at(1, {1, 2}), at(3, {3}), at(0, {0}, 1)) == (1, 2, 3, 0, 0)


def test_trace_line(spark):
    add = "41" "04d2" "0000" "1f1aced9f07b" "000000000000002a" "42" "00000064" + b"SIMTEST ".hex() + "0016ed24"
    cases = [(0, add, 36, True), (1, "52" + "00" * 9, 10, True), (2, "", 0, True), (3, "4100", 36, False), (4, add.replace("2a42", "2a5a"), 36, True), (5, "4400", 2, True)]
    df = spark.createDataFrame([(i, bytearray.fromhex(b), n, c) for i, b, n, c in cases], "i int, frame binary, declared int, complete boolean")
    lines = {r["index"]: r.line for r in trace.lines(df, [], F.col("i")).collect()}
    assert lines == {
        0: "0 D 41 0036 04d2 0000 1f1aced9f07b 000000000000002a 42 00000064 53494d5445535420 0016ed24",
        1: "1 S 52 0010", 2: "2 L -- 0000", 3: "3 T -- 0036", 4: "4 M 41 0036", 5: "5 L 44 0002",
    }
    text = spark.createDataFrame([("# x",), ("",), (lines[0],), (lines[0][:-1],), ("7 S 52 0010 aa",), (lines[3],), ("junk",)], "line string")
    assert sorted((-1 if r["index"] is None else r["index"], r.ok) for r in trace.parsed(text).collect()) == [(-1, False), (0, False), (0, True), (3, True), (7, False)]


def test_hex_lines(spark):
    data = bytes(range(130))
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, None)], "source long, content binary")
    got = sorted((r.source, r.n, r.line) for r in trace.hex_lines(df).collect())
    assert got == [(1, i, data[64 * i : 64 * i + 64].hex()) for i in range(3)]


def record(seq, frame=b"abc"):
    body = b"HWAL" + struct.pack(">QHH", seq, len(frame) + 2, len(frame)) + frame
    return body + struct.pack(">Q", hashes.fnv1a(body))


def test_log(spark):
    good = record(5) + record(6) + record(6) + record(9) + record(7)
    bad = bytearray(record(3))
    bad[15] ^= 1
    logs = {1: good, 2: record(1) + bytes(bad) + record(2), 3: record(1) + record(2)[:-1], 4: b"HWAL", 5: b"", 6: None, 7: record(0)}
    df = spark.createDataFrame([(k, 0, None if v is None else bytearray(v)) for k, v in logs.items()], "source long, segment long, content binary")
    got = {}
    for r in sorted(log.read(df).collect(), key=lambda r: (r.source, r.at)):
        got.setdefault(r.source, []).append(r.status)
    assert got == {1: ["ok", "ok", "duplicate", "gap", "ok"], 2: ["ok", "corrupt"], 3: ["ok", "truncated"], 4: ["truncated"], 7: ["duplicate"]}
    written = log.append(spark.createDataFrame([(1, 5, bytearray(b"abc"))], "source long, seq long, frame binary"), ["source"]).first()
    assert bytes(written.record) == record(5)


def test_raw_walk_and_receive_time(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\x02ab\x00\x00\x00\x03x"))], "source long, content binary")
    assert [(r.idx, r.declared, r.complete, bytes(r.frame)) for r in wire.walk_raw(df).collect()] == [(0, 2, True, b"ab"), (1, 0, True, b""), (2, 3, False, b"x")]
    times = spark.createDataFrame([(bytearray(struct.pack("<qq", 3, 7)),), (bytearray(struct.pack("<qq", 3, 10**9)),), (bytearray(struct.pack("<qq", 3, -1)),), (bytearray(8),)], "p binary")
    assert [r[0] for r in times.select(wire.receive_time(F.col("p"))).collect()] == [3_000_000_007, None, None, None]


def test_duplicate_packet_that_reaches_further_moves_nothing(spark):
    df = spark.createDataFrame([(0, i, f, n) for i, (f, n) in enumerate([(10, 3), (12, 5), (13, 0), (15, 0), (15, 2), (17, 1)])], "session long, arrival long, first long, n long")
    assert [(r.expected, r.state) for r in sorted(sequence.audited_packets(df).collect(), key=lambda r: r.arrival)] == [(10, "ok"), (13, "duplicate"), (13, "ok"), (13, "gap"), (13, "gap"), (17, "ok")]


RISK = "account long, seq long, ts_us long, event string, side string, price long, qty long, reference long"


def test_checks_in_order(spark):
    o = lambda qty=10, side="B", price=100, ref=100, ts=0, event="order": (ts, event, side, price, qty, ref)
    limits = {"order_notional": 5_000, "band": 10, "position": 60, "gross": 90, "rate": 2}
    rows = [o(), o(), o(), o(0), o(ref=None), o(price=111), o(price=110, qty=50), o(50, event="fill"), o(11), o(30, "S", event="fill"), o(11, "S"), o(5, ts=500_000), o(event="kill"), o(), o(event="reset"), o(5, ts=0), o(5, ts=900_000, side="S"), o(99, event="unfill")]
    want = ["ok", "ok", "rate_limit", "order_notional", "no_reference_price", "price_band", "order_notional", None, "position_limit", None, "gross_limit", "ok", None, "kill_switch", None, "rate_limit", "rate_limit", None]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], RISK)
    got = sorted(risk.checked(df, limits).collect(), key=lambda r: r.seq)
    assert [r.status for r in got] == want
    assert (got[-1].bid_shares, got[-1].ask_shares) == (0, 30)


def test_order_manager(spark):
    steps = [("submit", 10), ("cancel", 0), ("ack", 0), ("replace", 20), ("fill", 11), ("fill", 4), ("replace_ack", 0), ("cancel", 0), ("replace", 5), ("fill", 6), ("fill", 1), ("cancel", 0), ("submit", 0), ("submit", 7), ("submit", 8), ("kill", 0), ("ack", 0), ("submit", 1)]
    want = ["ok", "illegal_transition", "ok", "ok", "illegal_transition", "ok", "illegal_transition", "ok", "illegal_transition", "ok", "illegal_transition", "not_live", "order_notional", "ok", "pool_full", "ok", "illegal_transition", "kill_switch"]
    df = spark.createDataFrame([(1, i, 0, 3, e, "B", 100, q, 100) for i, (e, q) in enumerate(steps)], "account long, seq long, ts_us long, slot long, event string, side string, price long, qty long, reference long")
    got = sorted(manager.managed(df).collect(), key=lambda r: r.seq)
    assert [r.status for r in got] == want
    assert [(r.state, r.leaves, r.original) for r in got[3:6]] == [("pending_replace", 10, 20), ("pending_replace", 10, 20), ("partially_filled", 6, 20)]
    assert (got[9].state, got[15].state, got[15].leaves) == ("filled", "cancelled", 0)
    only = manager.managed(spark.createDataFrame([(1, 0, 0, 3, "ack", "B", 1, 1, 1)], df.schema)).first()
    assert (only.status, only.state) == ("unknown_order", None)


def test_session(spark):
    steps = [("login", None), ("accepted", 4), ("message", 5), ("message", 9), ("message", 6), ("done", 10), ("message", 10), ("message", 3), ("heartbeat", 10), ("logout", None)]
    df = spark.createDataFrame([(2, i, 10 * i, e, n) for i, (e, n) in enumerate(steps)], "session long, n long, ts_us long, event string, number long")
    got = sorted(session.followed(df, 15).collect(), key=lambda r: r.n)
    assert [(r.state, r.expected) for r in got] == [("logging_in", None), ("ready", 5), ("ready", 6), ("retransmitting", 6), ("retransmitting", 6), ("ready", 10), ("ready", 11), ("ready", 11), ("ready", 11), ("closed", 11)]
    assert got[3].reply == struct.pack(">cQQH", b"R", 2, 6, 3).hex() and got[8].reply == struct.pack(">cQ", b"H", 10).hex()
    assert [r.alive for r in got] == [False, True, True, True, True, True, False, True, True, True]


def test_queue_fills(spark):
    steps = [("trade", 0, 5, 0), ("place", 0, 10, 8), ("trade", 1, 5, 0), ("cancel", 1, 2, 0), ("trade", 2, 3, 0), ("trade", 9, 4, 0), ("trade", 9, 9, 0)]
    df = spark.createDataFrame([(1, i, t, e, 100, q, a) for i, (e, t, q, a) in enumerate(steps)], "placement long, n long, ts long, event string, px_raw long, qty long, ahead long")
    assert [r.filled for r in sorted(maker.queue_fills(df, 5).collect(), key=lambda r: r.n)] == [0, 0, 0, 0, 0, 4, 6]


def test_maker_keeps_its_limits_and_its_books(spark, sf):
    rows = maker.made(book.tops(tables.messages(spark, sf)), {**maker.PARAMETERS, "most": 30}).collect()
    assert sum(r.fill is not None for r in rows) > 20 and max(abs(r.position) for r in rows) <= 30
    for symbol in {r.symbol for r in rows}:
        position = cash = 0
        for r in sorted((r for r in rows if r.symbol == symbol), key=lambda r: r.n):
            sign = {"B": 1, "S": -1, None: 0}[r.fill]
            position += 10 * sign
            cash -= 10 * sign * (r.bid if sign > 0 else r.ask)
            assert (r.position, r.cash) == (position, cash)
            assert r.fill != "B" or r.bid_live
            assert r.fill != "S" or r.ask_live


def test_maker_volatility_is_that_of_the_series(spark, sf):
    obs = tables.observations(spark, sf)
    want = {(r.symbol, r.seq): r.sigma for r in plans.QUERIES["w05_sigma"](spark, sf).collect()}
    seen = {}
    for r in sorted(obs.collect(), key=lambda r: r.seq):
        got = seen.setdefault(r.symbol, maker.Volatility()).see(r.mid_raw)
        assert abs(got - want[r.symbol, r.seq]) < 1e-5


def test_fold_over_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k long, n long")
    total = lambda key, rows: iter([(*key, sum(r.n for r in rows))])
    assert sorted(map(tuple, folds.by_key(df, ["k"], ["n"], total, "k long, s long").collect()), key=str) == [(3, 3), (None, 3)]
    assert folds.by_key(df.where("n > 9"), ["k"], ["n"], total, "k long, s long").collect() == []


def test_stream_state_outlives_a_batch(spark, tmp_path):
    rows = [(0, 0, 1, "A", "S", "B", 10, 100, 0, 0, 0), (1, 1, 1, "E", None, None, 4, None, 1, 0, 0), (2, 1, 1, "X", None, None, 9, None, 1, 0, 0), (3, 1, 1, "D", None, None, 0, None, 1, 0, 0)]
    rows += [(1, 0, 2, "A", "T", "S", 5, 200, 0, 0, 0), (2, 1, 2, "X", None, None, 2, None, 1, 0, 0), (3, 1, 3, "D", None, None, 0, None, 1, 0, 0)]  # neighbours in the same state
    rows = [[r for r in rows if r[0] == t] for t in range(4)]
    kinds = "ts long, kind int, order_id long, tag string, symbol string, side string, qty long, px_raw long, line int, part long, supp long"
    for i, r in enumerate(rows):
        spark.createDataFrame(r, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = replay.finished(replay.level_changes(stream), "test")
    assert sorted(map(tuple, got.collect())) == [("S", "B", 100, -6, -1), ("S", "B", 100, -4, 0), ("S", "B", 100, 10, 1), ("T", "S", 200, -2, 0), ("T", "S", 200, 5, 1)]


def test_thousands(spark):
    df = spark.createDataFrame([(0,), (1234567,), (-1000,)], "n long")
    assert [r[0] for r in df.select(prices.thousands(F.col("n"))).collect()] == ["0", "1 234 567", "-1 000"]


def test_streamed_audit_sorts_by_arrival(spark, tmp_path):
    """Rows in any order of files and splits, in one micro-batch and in several."""
    rows = [(s, a, a // 4 - (a % 5 == 0) * (a % 7) + (a % 11 == 0)) for a in range(4000) for s in [a % 3]]
    df = spark.createDataFrame(rows, "session long, arrival long, observed long")
    kind = "session long, arrival long, observed long"
    df.orderBy(F.xxhash64("arrival")).repartition(6).write.parquet(f"{tmp_path}/mixed")
    for i in range(3):
        df.where((F.col("arrival") >= 1500 * i) & (F.col("arrival") < 1500 * (i + 1))).orderBy(F.xxhash64("arrival")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    want = sorted(map(tuple, sequence.audited(df).collect()))
    for stream in (spark.readStream.schema(kind).parquet(f"{tmp_path}/mixed"), spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/parts")):
        got = replay.audited(stream)
        got = got if not got.isStreaming else replay.finished(got, "sequence")
        assert sorted(map(tuple, got.collect())) == want
