"""Replaced orders: ids that replaces connect are folded together, all others by themselves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables
from ..sources.shared import cut
from . import book, folds

LIVE = "order_id bigint, symbol string, side string, px_raw bigint, size bigint, state int"


def chains(edges: DataFrame) -> DataFrame:
    """(order_id, chain) for edges (order_id, new_id): the least id that replaces connect an id with.

    Ids take the least label of their neighbours and then their label's label,
    until a round changes nothing; rounds are cut in the shared folder.
    """
    both = cut(edges.select("order_id", "new_id").union(edges.select("new_id", "order_id")).distinct().toDF("a", "b"))
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(near, "a").select("a", "label", F.least("label", "low").alias("low"))
        far = labels.select(F.col("a").alias("low"), F.col("label").alias("far"))
        moved = cut(low.join(far, "low").select("a", F.least("low", "far").alias("new"), "label"))
        labels = moved.select("a", F.col("new").alias("label"))
        if not moved.where("new <> label").head(1):
            return labels.select(F.col("a").alias("order_id"), F.col("label").alias("chain"))


def replay(key, rows):
    """A chain's live orders. A replace removes the original even if the new order is then refused."""
    held: dict = {}

    def place(order_id, symbol, side, px, qty):
        if order_id and order_id not in held and qty:
            held[order_id] = [symbol, side, px, qty, 0]

    for r in rows:
        if r.tag == "A":
            place(r.order_id, r.symbol, r.side, r.px_raw, r.qty)
            continue
        o = held.get(r.order_id)
        if o is None or (r.tag in "ECX" and r.qty > o[3]):
            continue
        if r.tag in "UD" or r.qty == o[3]:
            del held[r.order_id]
            if r.tag == "U":
                place(r.new_id, o[0], o[1], r.px_raw, r.qty)
        else:
            o[3] -= r.qty
            o[4] = 0 if r.tag == "X" else 1
    for order_id, o in held.items():
        yield (order_id, *o)


def live_orders(messages: DataFrame) -> DataFrame:
    """(order_id, symbol, side, px_raw, size, state) after messages that may replace orders (tag U, new_id)."""
    ids = chains(messages.where("tag = 'U'").select("order_id", "new_id"))
    chained = messages.join(ids, "order_id")
    order = ["ts", "kind", "order_id", "line", "part", "supp"]
    replaced = folds.by_key(chained.select("chain", *tables.ORDER, "order_id", "new_id", "tag", "symbol", "side", "qty", "px_raw"), ["chain"], order, replay, LIVE)
    rest = book.live_orders(messages.join(ids, "order_id", "left_anti").drop("new_id")).drop("ts")
    return rest.unionByName(replaced)
