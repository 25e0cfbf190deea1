"""Every query that SQL can express, against DuckDB; the others against naive models that share no code with them."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import book, sequence, series
from tapeworks.plans import queries as plans
from tapeworks.sources import tables


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_duckdb(spark, sf, duck, name):
    want = duck.sql(plans.ORACLES[name])
    names = sorted(want.columns)
    wanted = duck.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({plans.ORACLES[name]})").fetchall()
    got = plans.QUERIES[name](spark, sf)
    assert sorted(got.columns) == names
    assert rows(got) == sorted(wanted, key=lambda r: tuple(map(str, r)))


def naive_book(messages):
    """Orders left, by applying all messages in one global order."""
    orders, priority = {}, 0
    for m in sorted(messages, key=lambda m: (m.ts, m.kind, m.order_id, m.line, m.part, m.supp)):
        o = orders.get(m.order_id)
        if m.tag == "A":
            if o is None and m.order_id and m.qty:
                priority += 1
                orders[m.order_id] = [m.symbol, m.side, m.px_raw, m.qty, 0, priority]
        elif o is None:
            continue
        elif m.tag == "D" or m.qty == o[3]:
            del orders[m.order_id]
        elif m.qty < o[3]:
            o[3] -= m.qty
            o[4] = 0 if m.tag == "X" else 1
    return orders


def test_book_and_checksum_against_naive_book(spark, sf):
    want = naive_book(tables.messages(spark, sf).collect())
    got = book.live_orders(tables.messages(spark, sf)).collect()
    assert {r.order_id: [r.symbol, r.side, r.px_raw, r.size, r.state] for r in got} == {k: v[:5] for k, v in want.items()}
    sums = {}
    for symbol in {v[0] for v in want.values()}:
        value = 0xCBF29CE484222325
        for side in "BS":
            held = [(v[2] if side == "S" else -v[2], v[5], k, v) for k, v in want.items() if v[0] == symbol and v[1] == side]
            for _, _, k, v in sorted(held):
                for x in (k, v[2], v[3], v[4]):
                    for b in x.to_bytes(8, "little"):
                        value = (value ^ b) * 0x100000001B3 % 2**64
        sums[symbol] = f"{value:016x}"
    assert {r.symbol: r.checksum for r in plans.QUERIES["o08_checksum"](spark, sf).collect()} == sums


def test_partition_count_changes_nothing(spark, sf):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(rows(plans.QUERIES["o07_queue_position"](spark, sf)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_token_bucket_against_loop(spark, sf):
    orders = plans.risk_orders(spark, sf).select("symbol", "seq", "ts_us").collect()
    want, state = {}, {}
    for o in sorted(orders, key=lambda o: o.seq):
        left, at = state.get(o.symbol, (1_000_000, o.ts_us))
        if o.ts_us > at:
            left, at = min(1_000_000, left + o.ts_us - at), o.ts_us
        want[o.symbol, o.seq] = left >= 1_000_000
        state[o.symbol] = (left - 1_000_000 * want[o.symbol, o.seq], at)
    got = {(r.symbol, r.seq): r.allowed for r in plans.QUERIES["r04_token_bucket"](spark, sf).collect()}
    assert got == want


def test_over_reduce_changes_nothing_and_dead_ids_may_return(spark):
    ops = [("A", 10), ("E", 4), ("X", 7), ("X", 1), ("D", 0), ("A", 3), ("A", 5)]
    df = spark.createDataFrame([(i, 0, 1, t, "S", "B", q, 100, 0, 0, 0) for i, (t, q) in enumerate(ops)], "ts long, kind int, order_id long, tag string, symbol string, side string, qty long, px_raw long, line int, part long, supp long")
    log = sorted(book.journal(df).collect(), key=lambda r: r.ts)
    assert [x.outcome for x in log] == ["ok", "ok", "over_reduce", "ok", "ok", "ok", "duplicate_order"]
    last = book.live_orders(df).first()
    assert (log[-1].live, last.size, last.state, last.ts) == (True, 3, 0, 5)


def test_markouts_over_spans_and_at_the_end(spark):
    """Spans without mids, fills at a mid's own time, and fills that nothing follows."""
    obs = [(0, n, t, 100 + n) for n, t in enumerate([0, 5, 5, 40, 41, 300])] + [(1, 50, 7, 900)]
    fills = [(0, 60, t, 1, 1, 1, 1) for t in (0, 1, 5, 6, 40, 42, 299, 300, 301, 999)] + [(1, 61, 8, 1, 1, 1, 1), (2, 62, 8, 1, 1, 1, 1)]
    fills = [(s, q + i, *rest) for i, (s, q, *rest) in enumerate(fills)]
    got = series.markouts(spark.createDataFrame(obs, "symbol long, seq long, ts_us long, mid_raw long"), spark.createDataFrame(fills, "symbol long, seq long, ts_us long, mid_raw long, s long, px_raw long, size long"), 10, span_us=30)
    want = {}
    for s, seq, t, *_ in fills:
        own = [(o[2], o[1], o[3]) for o in obs if o[0] == s]
        later = sorted(o for o in own if o[0] >= t + 10)
        want[seq] = later[0][2] if later else sorted(own)[-1][2] if own else None
    assert {r.seq: r.mid_h for r in got.collect()} == want


def test_markouts_grow_with_the_rows(spark):
    """Ten times the rows of one symbol cost far less than a hundred times the time."""

    def seconds(n):
        obs = spark.range(n).selectExpr("0L AS symbol", "id AS seq", "id * 1000 AS ts_us", "1000000 + id % 977 AS mid_raw")
        fills = obs.where("seq % 5 = 0").selectExpr("symbol", "seq", "ts_us", "mid_raw", "1L AS s", "mid_raw AS px_raw", "1L AS size")
        start = time.perf_counter()
        series.markouts(obs, fills, 60_000_000).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 15 * seconds(40_000)


def test_sigmas_against_loop():
    rng = np.random.default_rng(2)
    for n, window in ((0, 4), (1, 4), (2, 4), (40, 4), (9000, 256), (300, 256)):
        mid = 1000 + np.cumsum(rng.integers(-3, 4, n) * (rng.random(n) < 0.7)).astype(np.int64)
        want = []
        for i in range(n):
            d = [abs(int(b) - int(a)) for a, b in zip(mid[max(0, i - window) : i], mid[max(0, i - window) + 1 : i + 1], strict=True)]
            m = 4 * sorted(d)[len(d) // 2] if d else 0
            want.append((sum((min(x, m) if m else x) ** 2 for x in d) / len(d)) ** 0.5 if len(d) > 1 else 0.0)
        assert np.allclose(series.sigmas(mid, window), want)


def test_pieces_of_a_long_symbol_change_nothing(spark):
    rows = [(n % 7 == 0, n, 1000 + n * n % 97) for n in range(3000)]
    obs = spark.createDataFrame([(int(s), n, m) for s, n, m in rows], "symbol long, seq long, mid_raw long")
    whole, parts = (sorted(map(tuple, series.volatility(obs, 16, size).collect())) for size in (1 << 14, 50))
    assert whole == parts and len(whole) == 3000


def test_series_in_any_buckets(spark, sf):
    obs = tables.observations(spark, sf)
    fills = tables.fills(obs)
    for whole, parts in ((series.changes(obs), series.changes(obs, 7)), (series.positions(fills), series.positions(fills, 7)), (series.profit(obs, fills), series.profit(obs, fills, 7))):
        assert rows(whole) == rows(parts)
    sent = tables.transmissions(spark, sf)
    assert rows(sequence.audited(sent)) == rows(sequence.audited(sent, 5))


def test_fold_against_loop_over_many_batches(spark):
    """One order with most messages, orders that die and return, and batches that cut orders."""
    rng = np.random.default_rng(4)
    rows = [(int(t), 0, int(rng.choice([1, 1, 1, 2, 3, 4, 0])), str(rng.choice(list("AAEECXXDPU"))), "S", "B", int(rng.integers(0, 9)), 100 + int(t), 0, 0, 0) for t in range(4000)]
    df = spark.createDataFrame(rows, "ts long, kind int, order_id long, tag string, symbol string, side string, qty long, px_raw long, line int, part long, supp long")
    held, want = {}, {}
    for ts, _, i, tag, *_, qty, px, _, _, _ in rows:
        o, told = held.get(i), "ok"
        if tag == "A":
            told = "duplicate_order" if o or not i else "zero_size" if not qty else "ok"
            if told == "ok":
                held[i] = [qty, 0, px]
        elif tag in "ECXD":
            told = "unknown_order" if not o else "over_reduce" if tag != "D" and qty > o[0] else "ok"
            if told == "ok":
                o[0] = 0 if tag == "D" else o[0] - qty
                o[1] = 0 if tag == "X" else 1
                if not o[0]:
                    del held[i]
        want[ts] = (told, i in held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {r.ts: (r.outcome, r.live) for r in book.journal(df).collect()}
    live = {r.order_id: [r["size"], r.state, r.px_raw] for r in book.live_orders(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == want and live == held


def test_tops_in_any_pieces(spark, sf):
    m = tables.messages(spark, sf)
    months, whole, days = (sorted(map(tuple, book.tops(m, p).collect()), key=str) for p in (None, F.lit(0), F.to_date("ts")))
    assert months == whole == days
