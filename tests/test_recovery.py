"""Snapshots, dumps and the shared folder."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import book, sequence
from tapeworks.sources import shared, snapshots, tables, trace


def test_a_changed_snapshot_is_found(spark, sf, tmp_path):
    m = tables.messages(spark, sf)
    orders = book.live_orders(m)
    snapshots.write(orders, f"{tmp_path}/s")
    assert {r.ok for r in snapshots.verified(spark, f"{tmp_path}/s").collect()} == {True}
    one = snapshots.read(spark, f"{tmp_path}/s").orderBy("order_id").first()
    changed = snapshots.read(spark, f"{tmp_path}/s").withColumn("size", F.col("size") + (F.col("order_id") == one.order_id).cast("long"))
    assert {r.symbol for r in snapshots.verified(spark, f"{tmp_path}/s", changed).where("NOT ok").collect()} == {one.symbol}
    gone = snapshots.read(spark, f"{tmp_path}/s").where(F.col("symbol") != one.symbol)
    assert {r.symbol for r in snapshots.verified(spark, f"{tmp_path}/s", gone).where("NOT ok").collect()} == {one.symbol}


def test_restored_states_last_until_told_otherwise(spark):
    held = spark.createDataFrame([(i, "S", "B", 100, 10, s, 0) for i, s in ((1, 1), (2, 1), (3, 1), (4, 0), (5, 1))], "order_id long, symbol string, side string, px_raw long, size long, state int, ts long")
    kinds = "ts long, kind int, order_id long, tag string, symbol string, side string, qty long, px_raw long, line int, part long, supp long"
    after = spark.createDataFrame([(5, 1, 2, "X", None, None, 3, None, 0, 0, 0), (5, 1, 3, "E", None, None, 11, None, 0, 0, 0), (5, 1, 4, "E", None, None, 2, None, 0, 0, 0), (5, 1, 5, "D", None, None, 0, None, 0, 0, 0), (6, 0, 5, "A", "S", "S", 7, 90, 0, 0, 0)], kinds)
    got = sorted((r["order_id"], r["size"], r["state"]) for r in snapshots.restored(held, after).collect())
    assert got == [(1, 10, 1), (2, 7, 0), (3, 10, 1), (4, 8, 1), (5, 7, 0)]


def test_dumps_with_blanks_and_comments(spark, tmp_path):
    import os

    os.makedirs(f"{tmp_path}/d/symbol=S")
    with open(f"{tmp_path}/d/symbol=S/part", "w") as f:
        f.write("# a comment\r\n\n0 L B 00000000000f4240 1 000000000000000a\r\n1 O B 0000000000000007 00000000000f4240 000000000000000a 1 0\n2 O A zz\n# checksum 0123\n")
    levels, orders, sums = trace.read_dump(spark, f"{tmp_path}/d")
    assert [tuple(r) for r in levels.collect()] == [("S", 0, "B", 1_000_000, 1, 10)]
    assert sorted((r.n, r.order_id, r.px_raw) for r in orders.where("n = 1").collect()) == [(1, 7, 1_000_000)]
    assert [tuple(r) for r in sums.collect()] == [("S", "0123")]


def test_a_resync_counts_or_sets_the_base(spark):
    rows = [(0, i, o, r) for i, (o, r) in enumerate([(5, False), (6, False), (9, False), (2, True), (3, False), (10, False)])]
    df = spark.createDataFrame(rows, "session long, arrival long, observed long, resync boolean")
    assert tuple(sequence.resynced(df).first()) == (0, 1, 4, 2, 1, 2, False)
    assert tuple(sequence.resynced(df, rebase=True).first()) == (0, 1, 6, 8, 2, 0, False)


def test_the_folder_is_shared_or_refused(spark):
    """Without a folder that is shared, a local session gets one of its own, and a cluster an error."""
    assert shared.folder(spark).endswith(spark.sparkContext.applicationId)

    def session(master):
        nothing = SimpleNamespace(get=lambda *_: None)
        held = SimpleNamespace(isDefined=lambda: False)
        context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: nothing, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held)))
        return SimpleNamespace(conf=nothing, sparkContext=context)

    assert shared.folder(session("local[4]")).endswith("/app")
    with pytest.raises(ValueError):
        shared.folder(session("spark://there:7077"))
