"""Frames written by hand, byte by byte."""

from decimal import Decimal

from tapeworks.functions import prices
from tapeworks.sources import wire
from pyspark.sql import functions as F

HEAD = "0001" "0002" "1F1ACED9F07B"
ADD = "41" + HEAD + "0000000000000007" + "42" + "00000064" + b"ABC     ".hex() + "000F4240"
CASES = {
    "add": (ADD, "ok"),
    "id 0": (ADD.replace("0000000000000007", "0000000000000000"), "malformed"),
    "side": (ADD.replace("0742", "075A"), "malformed"),
    "executed": ("45" + HEAD + "0000000000000007" + "00000005" + "0000000000000009", "ok"),
    "cancel": ("58" + HEAD + "0000000000000007" + "00000005", "ok"),
    "delete": ("44" + HEAD + "0000000000000007", "ok"),
    "replace": ("55" + HEAD + "0000000000000007" + "0000000000000008" + "00000005" + "000F4240", "ok"),
    "broken": ("42" + HEAD + "FFFFFFFFFFFFFFFF", "ok"),
    "event": ("53" + HEAD + "4F", "ok"),
    "short": ("44" + HEAD, "bad_length"),
    "unknown": ("52" + HEAD, "unknown_type"),
    "empty": ("", "bad_length"),
}


def test_decode(spark):
    df = spark.createDataFrame([(k, bytearray.fromhex(v[0])) for k, v in CASES.items()], "name string, frame binary")
    got = {r.name: r for r in wire.decode(df).collect()}
    assert {k: r.status for k, r in got.items()} == {k: v[1] for k, v in CASES.items()}
    a = got["add"]
    assert (a.locate, a.tracking, a.ts_ns, a.order_id, a.side, a.qty, a.stock, a.px_raw) == (1, 2, 0x1F1ACED9F07B, 7, "B", 100, "ABC", 1_000_000)
    assert got["broken"].match == 2**64 - 1
    assert got["replace"].new_id == 8


def packet(seq, count, *frames):
    return b"S1        " + seq.to_bytes(8, "big") + count.to_bytes(2, "big") + b"".join(len(f).to_bytes(2, "big") + f for f in frames)


def test_walk(spark):
    one, two = bytes.fromhex(CASES["delete"][0]), bytes.fromhex(CASES["event"][0])
    data = packet(5, 2, one, two) + packet(7, 0) + packet(7, 1, two) + packet(8, 0xFFFF) + packet(9, 1, one)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(packet(1, 2, one, two)[:-3])), (3, None), (4, bytearray(b"short"))], "source long, content binary")
    got = wire.walk(df).collect()
    assert [(r.source, r.packet_no, int(r.seq), r.idx, bytes(r.frame)) for r in got] == [(1, 0, 5, 0, one), (1, 0, 6, 1, two), (1, 2, 7, 0, two), (2, 0, 1, 0, one)]
    assert [(r.source, r.complete) for r in wire.walk(df, emit_partial=True).collect()][-1] == (2, False)


def test_prices(spark):
    df = spark.createDataFrame([("1",), ("12.3",), ("0.0001",), ("1.23456",), ("-1",), ("1e3",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(prices.parse_price(F.col("t"))).collect()]
    assert got == [10000, 123000, 1, None, None, None, None, None]


def test_encode_fits_or_tells(spark):
    """Every tag comes back as it went; what doesn't fit its field gets no frame."""
    kinds = "tag string, order_id decimal(20,0), new_id decimal(20,0), qty long, px_raw long, symbol string, side string, match decimal(20,0), printable string, cross_type string, event_code string, ts_ns long"
    most = Decimal(2**64 - 1)
    rows = [(t, most, Decimal(8), 2**32 - 1, 2**32 - 1, "ABCDEFGH", "S", most, "N", "O", "C", 2**48 - 1) for t in wire.FIELDS]
    back = {r.tag: r for r in wire.decode(wire.encode(spark.createDataFrame(rows, kinds)).where("fits").select("frame")).collect()}
    assert sorted(back) == sorted(wire.FIELDS) and {r.status for r in back.values()} == {"ok"}
    assert all(back[t].order_id == 2**64 - 1 and back[t].ts_ns == 2**48 - 1 for t in "AECXDUP")
    assert (back["U"].new_id, back["U"].px_raw, back["Q"].match, back["Q"].cross_type, back["S"].event_code, back["C"].printable) == (8, 2**32 - 1, 2**64 - 1, "O", "C", "N")
    odd = [("A", 1, 0, 2**32, 1, "A", "B"), ("A", 1, 0, -1, 1, "A", "B"), ("A", 1, 0, 1, 2**32, "A", "B"), ("A", 1, 0, 1, 1, "TOOLONGNAME", "B"), ("A", 1, 0, 1, 1, "€", "B"), ("K", 1, 0, 1, 1, "A", "B"), ("A", None, None, None, None, None, None)]
    made = wire.encode(spark.createDataFrame(odd, "tag string, order_id long, new_id long, qty long, px_raw long, symbol string, side string"))
    assert [r.fits for r in made.collect()] == [False] * 6 + [True]
    numbered = made.withColumns({"session": F.lit(1), "seq": F.lit(1).cast("long")})
    try:
        wire.packets(numbered).collect()
        raise AssertionError("a packet of frames that are not there")
    except Exception as e:
        assert "no frame for message" in str(e)


def test_replace_into_nothing_decodes(spark):
    frame = CASES["replace"][0].replace("0000000000000008", "0000000000000000")
    assert wire.decode(spark.createDataFrame([(bytearray.fromhex(frame),)], "frame binary")).first().status == "ok"


def test_files_are_walked(spark, tmp_path):
    one = bytes.fromhex(CASES["delete"][0])
    data = {5: packet(5, 1, one) + packet(6, 2, one, one), 9: packet(1, 3, one, one, one)[:-1], 11: b"", 12: packet(1, 2, one, one)[: -len(one) - 1]}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "source long, content binary")
    assert wire.write_captures(df, f"{tmp_path}/caps") == 4
    assert wire.write_captures(df, f"{tmp_path}/caps") == 4
    files = wire.captures(spark, f"{tmp_path}/caps")
    assert sorted(bytes(r.content) for r in files.collect()) == sorted(v for v in data.values() if v)
    w = wire.decode(wire.walk(files, emit_partial=True))
    assert sorted((r.status, int(r.seq)) for r in w.collect()) == [("ok", 1), ("ok", 1), ("ok", 2), ("ok", 5), ("ok", 6), ("ok", 7), ("truncated", 2), ("truncated_body", 3)]


def test_raw_to_packets(spark):
    tags = "SADAX"
    raw = b"".join(len(b).to_bytes(2, "big") + b for b in (t.encode() + bytes(i) for i, t in enumerate(tags)))
    df = lambda data: wire.walk_raw(spark.createDataFrame([(1, bytearray(data))], "source long, content binary"))
    made = lambda data, **k: [bytes(r.content) for r in sorted(wire.repacked(df(data), "SAMPLE0000", **k).collect(), key=lambda r: r.packet_no)]
    head = lambda first, n: b"SAMPLE0000" + first.to_bytes(8, "big") + n.to_bytes(2, "big")
    cuts = [0, 3, 7, 12, 18, 25]
    assert made(raw) == [head(0, 5) + raw]
    assert made(raw[:-1], skip_to="A", blocks=2) == [head(1, 2) + raw[3:12], head(3, 1) + raw[12:18]]
    assert made(raw, skip_to="Z") == []
    assert made(raw[:7] + b"\0\0" + raw[7:]) == [head(0, 2) + raw[:7]]
    for most in range(0, 80, 7):
        want, out, i = [], 0, 0
        while i < 5:
            first = i
            while i < 5 and i - first < 2 and out + cuts[i + 1] - cuts[i] <= most:
                i += 1
            if i == first:
                break
            want.append(head(first, i - first) + raw[cuts[first] : cuts[i]])
            out += len(want[-1])
        assert made(raw, most_bytes=most, blocks=2) == want


def test_symbols_alike(spark):
    df = spark.createDataFrame([("abc  ", "ABC"), ("abc", "abd"), (" abc", "abc")], "a string, b string")
    assert [r[0] for r in df.select(wire.same_symbol(F.col("a"), F.col("b"))).collect()] == [True, False, False]
