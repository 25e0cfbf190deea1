"""What must stay bounded or be dealt over tasks on larger tables."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeworks.functions import hashes
from tapeworks.operators import maker, series, session
from tapeworks.plans import records, trading
from tapeworks.sources import log, tables, trace, wire


class Taken:
    """Stands for a DataFrame; keeps the function that it was to be mapped with."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def frames(n):
    return [struct.pack(">H", 19) + b"D" + i.to_bytes(18, "big") for i in range(n)]


def packed(n):
    f = frames(n)
    return b"".join(b"S1".ljust(10) + struct.pack(">QH", i + 1, len(f[i : i + 64])) + b"".join(f[i : i + 64]) for i in range(0, n, 64))


@pytest.mark.parametrize("walk, made", [(wire.walk, packed), (wire.walk_raw, lambda n: b"".join(frames(n)))])
def test_walks_leave_in_batches_of_bounded_length(spark, walk, made):
    contents = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([made(20_000), None, made(5)])], ["source", "content"])
    told = list(walk(Taken()).run([contents, contents]))
    assert max(b.num_rows for b in told) <= 8192
    assert sum(b.num_rows for b in told) == 2 * 20_005
    rows = [r for b in told for r in b.column("frame").to_pylist()]
    assert rows[:20_000] == [f[2:] for f in frames(20_000)] and [b.column("source")[0].as_py() for b in told][:1] == [1]


def test_wide_frames_leave_in_batches_of_bounded_bytes(spark):
    wide = (struct.pack(">H", 60_000) + bytes(60_000)) * 1_000
    told = list(wire.walk_raw(Taken()).run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([wide])], ["source", "content"])]))
    assert max(b.nbytes for b in told) < 1 << 25 and sum(b.num_rows for b in told) == 1_000


def test_contents_go_to_python_in_batches_of_bounded_bytes(spark, sf, tmp_path):
    named = "spark.sql.execution.arrow.maxBytesPerBatch"
    for read in (lambda: tables.read(spark, sf, "orders"), lambda: wire.captures(spark, str(tmp_path))):
        spark.conf.unset(named)
        read()
        contents = spark.range(0, 300, 1, 1).select(F.expr("cast(repeat('x', 100000) AS binary)").alias("content"))
        told = contents.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in told) == 300 and max(r.size for r in told) < 5 << 20
        spark.conf.set(named, "1m")
        read()
        assert spark.conf.get(named) == "1m"  # a lower setting stays
    spark.conf.unset(named)


def test_sessions_are_numbered_by_day_and_in_order(spark, sf):
    m = tables.messages(spark, sf)
    key = lambda r: (r.session, r.ts, r.kind, r.line, r.part, r.supp, r.order_id)
    got = sorted(tables.in_sessions(m).collect(), key=key)
    seen = {}
    for r in got:
        seen[r.session] = seen.get(r.session, 0) + 1
        assert r.seq == seen[r.session]
    plan = records.frames(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and all("day#" in x for x in plan.splitlines() if "row_number()" in x and "windowspecdefinition" in x)


def test_sessions_with_messages_of_no_time(spark, sf):
    m = tables.messages(spark, sf).limit(40).withColumn("ts", F.when(F.col("order_id") % 3 > 0, F.col("ts")))
    got = tables.in_sessions(m, 2).collect()
    assert len(got) == 40
    for s in (0, 1):
        assert sorted(r.seq for r in got if r.session == s) == list(range(1, 1 + sum(r.session == s for r in got)))


def followed_by_loop(rows, timeout):
    """The client one event after the other: (state, expected, reply, alive)."""
    state, expected, heard, told = "idle", None, None, []
    for r in rows:
        alive = state != "idle" if state in ("idle", "logging_in") or heard is None else r.ts_us - heard <= timeout
        reply = b""
        if r.event in ("message", "heartbeat"):
            heard = r.ts_us
        if r.event in ("login", "refused", "logout"):
            state = {"login": "logging_in", "refused": "idle", "logout": "closed"}[r.event]
        elif r.event == "accepted":
            state, expected, heard = "ready", r.number + 1, None
        elif r.event == "heartbeat":
            reply = struct.pack(">cQ", b"H", r.number)
        elif r.event == "done":
            state, expected = ("ready" if state == "retransmitting" else state), r.number
        elif state == "ready" and r.number == expected:
            expected += 1
        elif state == "ready" and r.number > expected:
            state, reply = "retransmitting", struct.pack(">cQQH", b"R", r.session, expected, min(r.number - expected, 0xFFFF))
        told.append((state, expected, reply.hex(), alive))
    return told


def test_session_in_any_buckets_and_no_session_in_one_task(spark):
    pick = random.Random(7)
    kinds = ["message"] * 14 + ["heartbeat", "done", "accepted", "login", "logout", "refused"]
    rows = [(s, 3 * i, 10 * i + pick.randrange(30), pick.choice(kinds), pick.randrange(12) * pick.choice([1, 1, 1, 9000])) for s in range(40) for i in range(120)]
    df = spark.createDataFrame(rows, "session long, n long, ts_us long, event string, number long")
    for bucket in (7, 1 << 16):
        out = session.followed(df, 35, bucket)
        got = sorted(out.collect(), key=lambda r: (r.session, r.n))
        for s in range(40):
            mine = [Row(session=a, n=b, ts_us=c, event=d, number=e) for a, b, c, d, e in rows if a == s]
            assert [(r.state, r.expected, r.reply, r.alive) for r in got if r.session == s] == followed_by_loop(mine, 35)
        assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_transmissions_in_any_buckets(spark, sf):
    assert sorted(tables.transmissions(spark, sf, 13).collect()) == sorted(tables.transmissions(spark, sf).collect())


def judged_by_loop(seqs, last):
    told = []
    for seq in seqs:
        told.append("duplicate" if seq <= last else "gap" if last and seq != last + 1 else "ok")
        last = seq if told[-1] == "ok" else last
    return told


def test_log_is_judged_by_segments(spark):
    pick = random.Random(5)
    logs = {}
    for source in range(30):
        near, seqs = pick.randrange(5), []
        for _ in range(90):
            near = max(near + pick.choice([1, 1, 1, 1, 0, -1, 2, -3]), 0)
            seqs.append(near)
        logs[source] = seqs
    rows = [(s, n, seq, bytearray(b"D" * (n % 5))) for s, seqs in logs.items() for n, seq in enumerate(seqs)]
    r = log.append(spark.createDataFrame(rows, "source long, n long, seq long, frame binary"), ["source", "n"])
    for applied in (0, 3):
        out = log.read(log.segments(r, 7), applied)
        got = sorted(out.collect(), key=lambda r: (r.source, r.segment, r.at))
        for s, seqs in logs.items():
            mine = [r for r in got if r.source == s]
            assert [r.seq for r in mine] == seqs and [r.status for r in mine] == judged_by_loop(seqs, applied)
    sorts = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in x]
    assert sorts and not any("frame" in x for x in sorts)


def test_log_ends_with_its_first_broken_segment(spark):
    r = [(1, n, n + 1, bytearray(b"abc")) for n in range(20)]
    made = log.segments(log.append(spark.createDataFrame(r, "source long, n long, seq long, frame binary"), ["source", "n"]), 5)
    broken = made.withColumn("content", F.when(F.col("segment") == 2, F.expr("substring(content, 1, length(content) - 30)")).otherwise(F.col("content")))
    got = sorted(log.read(broken).collect(), key=lambda r: (r.segment, r.at))
    assert [(r.segment, r.status) for r in got] == [(0, "ok")] * 5 + [(1, "ok")] * 5 + [(2, "ok")] * 3 + [(2, "truncated")]


def test_log_leaves_in_batches_of_bounded_length(spark):
    body = b"HWAL" + struct.pack(">QHH", 1, 2, 0)
    content = (body + hashes.fnv1a(body).to_bytes(8, "big")) * 20_000
    taken = Taken()
    log.found(taken)
    told = list(taken.run([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([content])], ["source", "segment", "content"])]))
    assert max(b.num_rows for b in told) <= 8192 and sum(b.num_rows for b in told) == 20_000


def test_hashes_side_by_side():
    texts = [b"", b"a", b"", b"abc" * 50, bytes(range(256)), b"b"]
    ends = np.cumsum([len(x) for x in texts])
    got = hashes.fnv1a_of(np.frombuffer(b"".join(texts), np.uint8), ends - [len(x) for x in texts], ends)
    assert got.tolist() == [hashes.fnv1a(x) for x in texts]


def test_a_trace_is_written_in_pieces(spark, tmp_path):
    lines = spark.range(5_000).select(F.lit(1).alias("session"), F.col("id").alias("index"), F.concat(F.col("id"), F.lit(" D")).alias("line"))
    trace.write(lines, str(tmp_path / "t"), 100)
    files = sorted(p.read_text().splitlines() for p in (tmp_path / "t").glob("*.txt"))
    assert sorted(x for f in files for x in f) == sorted(f"{i} D" for i in range(5_000))
    assert all([int(x.split()[0]) for x in f] == sorted(int(x.split()[0]) for x in f) for f in files)


def test_makers_volatility_is_no_work_of_the_fold(spark):
    rows = [("S", n, 999_000 + 100 * (n % 7), 1_001_000 + 100 * (n % 5)) for n in range(600)]
    out = maker.made(spark.createDataFrame(rows, "symbol string, n long, best_bid long, best_ask long"))
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    mid, seen = maker.Volatility(), [r.mid_raw for r in sorted(out.collect(), key=lambda r: r.n)]
    assert seen == [(b + a) // 2 for _, _, b, a in rows]
    raw = series.raw_volatility(spark.createDataFrame([("S", n, m) for n, m in enumerate(seen)], "symbol string, seq long, mid_raw long"), size=300)
    assert [r.raw for r in sorted(raw.collect(), key=lambda r: r.seq)] == [mid.see(m) for m in seen]


def test_trace_fields_are_plain_expressions_that_the_jvm_compiles(spark, sf):
    body = bytes(range(1, 60))
    rows = [(n, bytearray(t.encode() + body[: size - 1])) for n, (t, (size, _)) in enumerate(wire.FIELDS.items())]
    whole = spark.createDataFrame(rows, "n long, frame binary").withColumns({"declared": F.length("frame"), "complete": F.lit(True)})
    whole = whole.withColumn("frame", F.when(F.substring("frame", 1, 1).isin(bytearray(b"A"), bytearray(b"P")), F.concat(F.substring("frame", 1, 19), F.lit(bytearray(b"B")), F.expr("substring(frame, 21, 40)"))).otherwise(F.col("frame")))
    frame = {r.n: bytes(r.frame) for r in whole.collect()}
    for r in trace.lines(whole, ["n"], F.col("n")).collect():
        code, kind, length, *fields = r.line.split(" ")[1:]
        data = frame[r.n]
        assert code == "D" and kind == data[:1].hex() and int(length) == len(data)
        assert fields == [data[o : o + s].hex() for _, o, s in trace.told(chr(data[0]))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = records.traced(spark, sf)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code, longest = debug.codegenStringSeq(plan).iterator(), 0
        while code.hasNext():
            longest = max(longest, code.next()._3().maxMethodCodeSize())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert longest < 8000  # HotSpot interprets longer methods
    assert "lambdafunction" not in plan.toString()


def test_a_trace_is_made_once_to_be_compared(spark, sf):
    plan = records.j08(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan and "lineitem" not in plan and "l_shipdate" not in plan


def test_messages_are_sorted_once_to_meet_their_add(spark, sf):
    named = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        plan = trading.t08(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in named:
            spark.conf.unset(k)
    assert plan.count("Sort [") == 3  # messages, adds, and what the fold goes through


def test_fills_number_each_orders_messages(spark, sf):
    seen = {}
    for r in trading.t08(spark, sf).collect():
        seen.setdefault(r.placement, []).append(r.n)
    sizes = {r.order_id: r["count"] for r in tables.messages(spark, sf).groupBy("order_id").count().collect()}
    assert all(sorted(n) == list(range(1, sizes[k] + 1)) for k, n in seen.items())
