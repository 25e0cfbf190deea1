"""The order book as data: each order's life is a fold over its own messages.

An order's state depends on its own messages only, so books of any number of
symbols are built in parallel by order, and levels, totals and the top of the
book are aggregates of the orders that still live. Reductions beyond what is
left are rejected and change nothing, which no running sum expresses; so the
fold goes through messages that one shuffle has sorted by order and time. It is
a stream over Arrow batches: a step takes one message of every order in the
batch at once, and only the last order's state outlives a batch, so an order
of any length needs no more memory than a batch.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import hashes
from ..sources import shared, tables
from . import folds

NEW, PARTIAL, FILLED, CANCELLED = 0, 1, 2, 3
OUTCOMES = ["ok", "duplicate_order", "zero_size", "unknown_order", "over_reduce"]
OK, DUPLICATE, ZERO, UNKNOWN, OVER = range(5)
#: Codes of the tags that change an order; others pass and change nothing.
CODES = {"A": 0, "E": 1, "C": 1, "X": 2, "D": 3}
ADD, EXECUTE, CANCEL, DELETE, PASS = range(5)
#: Where fewer orders than this still have messages in a batch, they are gone through one by one.
FEW = 4


def steps(code: np.ndarray, qty: np.ndarray, named: np.ndarray, given: np.ndarray, first: np.ndarray, live: np.ndarray, left: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each message's outcome, what it added to its order's shares, and the order after it: alive, shares left, state, row of its add.

    first: where each order's messages begin, and the end. named: whether the
    message names an order (an id of 0 is no order). given: the state that an
    add starts with. live, left and state are those before the orders' first
    messages, and are changed; an add before these rows has row -1.
    """
    n = len(code)
    outcome, change = np.zeros(n, np.int8), np.zeros(n, np.int64)
    after_live, after_left, after_state, after_add = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int64)
    count, add = np.diff(first), np.full(len(first) - 1, -1, np.int64)
    by_size = np.argsort(-count, kind="stable")
    reach = np.searchsorted(-count[by_size], -np.arange(1, count.max(initial=0) + 1), "right")
    k = 0
    while k < len(reach) and reach[k] > FEW:
        who = by_size[: reach[k]]
        at = first[who] + k
        c, q, alive, rem, kind = code[at], qty[at], live[who], left[who], state[who]
        adds, reduces = c == ADD, (c == EXECUTE) | (c == CANCEL)
        o = np.where(adds, np.where(alive | ~named[at], DUPLICATE, np.where(q == 0, ZERO, OK)), np.where(~alive & (c != PASS), UNKNOWN, np.where(reduces & (q > rem), OVER, OK)))
        done = (o == OK) & (c != PASS)
        now = np.where(done, np.where(adds, q, np.where(c == DELETE, 0, rem - q)), rem)
        over = done & ~adds & ((c == DELETE) | (now == 0))
        kind = np.where(done, np.where(over, np.where(c == EXECUTE, FILLED, CANCELLED), np.where(adds, given[at], np.where(c == EXECUTE, PARTIAL, NEW))), kind)
        alive = np.where(done, ~over, alive)
        add[who] = np.where(done & adds, at, add[who])
        live[who], left[who], state[who] = alive, now, kind
        outcome[at], change[at] = o, now - rem
        after_live[at], after_left[at], after_state[at], after_add[at] = alive, now, kind, add[who]
        k += 1
    for g in by_size[: reach[k]].tolist() if k < len(reach) else []:
        alive, rem, kind, placed = bool(live[g]), int(left[g]), int(state[g]), int(add[g])
        for at, (c, q, known) in enumerate(zip(code[first[g] + k : first[g + 1]].tolist(), qty[first[g] + k : first[g + 1]].tolist(), named[first[g] + k : first[g + 1]].tolist(), strict=True), int(first[g]) + k):
            before, o = rem, OK
            if c == ADD:
                o = DUPLICATE if alive or not known else ZERO if q == 0 else OK
                if o == OK:
                    alive, rem, kind, placed = True, q, int(given[at]), at
            elif c != PASS:
                o = UNKNOWN if not alive else OVER if c != DELETE and q > rem else OK
                if o == OK:
                    rem = 0 if c == DELETE else rem - q
                    alive = c != DELETE and rem > 0
                    kind = (PARTIAL if c == EXECUTE else NEW) if alive else FILLED if c == EXECUTE else CANCELLED
            outcome[at], change[at] = o, rem - before
            after_live[at], after_left[at], after_state[at], after_add[at] = alive, rem, kind, placed
        live[g], left[g], state[g] = alive, rem, kind
    return outcome, change, after_live, after_left, after_state, after_add


def followed(kinds: dict[str, str], last_only: bool):
    """Task function: messages sorted by order to what became of them, or to the orders that live after their last one."""
    held = ["symbol", "side", "px_raw", "placed"]
    types = {"symbol": "string", "side": "string", "px_raw": "bigint", "placed": kinds["ts"]}
    fields = {"order_id": "bigint", **types, "size": "bigint", "state": "int"} if last_only else {**{c: kinds[c] for c in (*tables.ORDER, "order_id", "tag")}, "until": kinds["ts"], "outcome": "string", "live": "boolean", "change": "bigint", "left": "bigint", "state": "int", **types}
    ddl = ", ".join(f"{c} {t}" for c, t in fields.items())
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    source = {"placed": "ts"}

    def run(batches):
        carried = None  # the last order: id, alive, left, state and one row of what its add told
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids = col["order_id"].to_numpy(zero_copy_only=False)
            first = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, n]
            live, left, state = np.zeros(len(first) - 1, bool), np.zeros(len(first) - 1, np.int64), np.zeros(len(first) - 1, np.int8)
            if carried and carried[0] == ids[0]:
                live[0], left[0], state[0] = carried[1:4]
            code, qty = col["code"].to_numpy(), col["qty"].fill_null(0).to_numpy()
            outcome, change, alive, rem, kind, add = steps(code, qty, ids != 0, col["given"].to_numpy(), first, live, left, state)
            rows = [pa.concat_arrays([carried[4][i] if carried and carried[0] == ids[0] else pa.nulls(1, col[source.get(c, c)].type), col[source.get(c, c)]]) for i, c in enumerate(held)]
            keep = np.flatnonzero(alive & (col["final"].to_numpy(zero_copy_only=False))) if last_only else np.arange(n)
            told = {c: rows[i].take(pa.array(add[keep] + 1)) for i, c in enumerate(held)}
            if last_only:
                out = {"order_id": col["order_id"].take(pa.array(keep)), "size": pa.array(rem[keep]), "state": pa.array(kind[keep].astype(np.int32)), **told}
            else:
                out = {**col, "outcome": pa.array(OUTCOMES).take(pa.array(outcome)), "live": pa.array(alive), "change": pa.array(change), "left": pa.array(rem), "state": pa.array(kind), **told}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in schema], schema=schema)
            carried = (ids[-1], live[-1], left[-1], state[-1], [r.slice(int(add[-1]) + 1, 1) for r in rows])

    return run, ddl


def by_order(messages: DataFrame) -> DataFrame:
    """Messages sorted by order and time within partitions of whole orders, with until (when the order's next message came), final, code and given."""
    w = Window.partitionBy("order_id").orderBy(*tables.ORDER)
    code = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), F.col("tag")), F.lit(PASS)).cast("tinyint")
    given = F.coalesce(F.col("state"), F.lit(NEW)) if "state" in messages.columns else F.lit(NEW)
    return messages.select("order_id", *tables.ORDER, "tag", "symbol", "side", "px_raw", "qty", code.alias("code"), given.cast("tinyint").alias("given"), F.lead("ts").over(w).alias("until"), F.lead(F.lit(1)).over(w).isNull().alias("final"))


def journal(messages: DataFrame) -> DataFrame:
    """Messages with what became of them: ORDER's columns, order_id, tag, until, outcome, live, change, left, state, symbol, side, px_raw, placed.

    change is what the message added to the order's shares, left and state are
    the order's after it, placed is the time of its add; until, when the
    order's next message came (null: never). Messages may have a column state,
    which their adds start with (a snapshot's orders).
    """
    run, kinds = followed(dict(messages.dtypes), last_only=False)
    return by_order(messages).mapInArrow(run, kinds)


def outcomes(messages: DataFrame) -> DataFrame:
    """(tag, outcome, live, n): messages by what became of them; live: whether the order lived on."""
    return journal(messages).groupBy("tag", "outcome", "live").agg(F.count("*").alias("n"))


def live_orders(messages: DataFrame) -> DataFrame:
    """(order_id, symbol, side, px_raw, size, state, ts): orders left in the book; ts: when they were placed."""
    run, kinds = followed(dict(messages.dtypes), last_only=True)
    needed = ["order_id", "ts", "symbol", "side", "px_raw", "qty", "code", "given", "final"]
    return by_order(messages).select(*needed).mapInArrow(run, kinds).select("order_id", "symbol", "side", "px_raw", "size", "state", F.col("placed").alias("ts"))


def better() -> Column:
    """Ascending from the best price on either side."""
    return F.when(F.col("side") == "B", -F.col("px_raw")).otherwise(F.col("px_raw"))


def bbo(orders: DataFrame) -> DataFrame:
    bid, ask = F.when(F.col("side") == "B", F.col("px_raw")), F.when(F.col("side") == "S", F.col("px_raw"))
    return orders.groupBy("symbol").agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"))


def mids(orders: DataFrame) -> DataFrame:
    return bbo(orders).where("best_bid IS NOT NULL AND best_ask IS NOT NULL").select("symbol", F.expr("(best_bid + best_ask) DIV 2").alias("mid_raw"))


def levels(orders: DataFrame) -> DataFrame:
    return orders.groupBy("symbol", "side", "px_raw").agg(F.sum("size").alias("agg_size"), F.count("*").alias("order_count"))


def top_levels(orders: DataFrame, k: int) -> DataFrame:
    ranked = levels(orders).withColumn("level", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(better())))
    return ranked.where(F.col("level") <= k)


def side_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("symbol", "side").agg(F.sum("size").alias("total_size"), F.count("*").alias("order_count"), F.countDistinct("px_raw").alias("level_count"))


def totals(orders: DataFrame) -> DataFrame:
    """Sizes and counts of each symbol's sides, of symbols and of all."""
    return orders.rollup("symbol", "side").agg(F.sum("size").alias("total_size"), F.count("*").alias("order_count"))


def priority(orders: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "side").orderBy(better(), "ts", "order_id")
    return orders.select("symbol", "side", "order_id", "px_raw", "size", "state", F.row_number().over(w).alias("priority"))


def queue_positions(orders: DataFrame) -> DataFrame:
    """Position in the level, from 0, and the shares ahead."""
    w = Window.partitionBy("symbol", "side", "px_raw").orderBy("ts", "order_id")
    ahead = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return orders.select("symbol", "side", "px_raw", "order_id", (F.row_number().over(w) - 1).alias("position"), ahead.alias("shares_ahead"))


def routed(messages: DataFrame) -> DataFrame:
    """(symbol, tag, n): changes by the symbol of the order they name; null where no order has the id."""
    adds = messages.where("tag = 'A'").select("order_id", F.col("symbol").alias("home"))
    changes = messages.where("tag <> 'A'").select("order_id", "tag")
    return changes.join(adds, "order_id", "left").groupBy(F.col("home").alias("symbol"), "tag").agg(F.count("*").alias("n"))


def orphans(messages: DataFrame) -> DataFrame:
    """(order_id, n): orders that have a change before they were placed, with how many."""
    adds = messages.where("tag = 'A'").select("order_id", F.col("ts").alias("placed"))
    early = messages.where("tag <> 'A'").select("order_id", "ts").join(adds, "order_id", "left").where("placed IS NULL OR ts < placed")
    return early.groupBy("order_id").agg(F.count("*").alias("n"))


def checksums(orders: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(*keys, checksum): FNV-1a over id, price, size and state, 8 little-endian bytes each, of bids, then asks, by priority.

    orders: (*keys, side, order_id, px_raw, size, state, ts). A fold in total
    order within a key; keys are independent.
    """

    def fold(key, rows):
        value = hashes.BASIS
        for r in rows:
            value = hashes.fnv1a(b"".join(int(x).to_bytes(8, "little") for x in (r.order_id, r.px_raw, r.size, r.state)), value)
        yield (*key, f"{value:016x}")

    kinds = dict(orders.dtypes)
    rows = orders.select(*keys, "side", better().alias("rank"), "ts", "order_id", "px_raw", "size", "state")
    return folds.by_key(rows, list(keys), ["side", "rank", "ts", "order_id"], fold, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", checksum string")


def combined(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, checksum): one value of all checksums, whatever their order."""
    halves = [F.bit_xor(F.conv(F.substring("checksum", i, 8), 16, 10).cast("long")) for i in (1, 9)]
    return sums.groupBy(*keys).agg(F.lower(F.concat(*(F.lpad(F.hex(h), 8, "0") for h in halves))).alias("checksum"))


def fingerprints(orders: DataFrame, ladder: bool = False) -> DataFrame:
    """(symbol, fingerprint): FNV-1a over each side's numbers of levels, of orders, and shares; with ladder over the levels too.

    The ladder tells each side's number of levels, then each level's price,
    shares and number of orders, best first, bids before asks.
    """

    def fold(key, rows):
        sums = {"B": [0, 0, 0], "S": [0, 0, 0]}
        told: dict = {"B": [], "S": []}
        for r in rows:
            for i, x in enumerate((1, r.order_count, r.agg_size)):
                sums[r.side][i] += x
            if ladder:
                told[r.side] += [r.px_raw, r.agg_size, r.order_count]
        numbers = [sums[side][i] for i in range(3) for side in "BS"]
        if ladder:
            numbers += [x for side in "BS" for x in (sums[side][0], *told[side])]
        value = hashes.BASIS
        for x in numbers:
            value = hashes.fnv1a(int(x).to_bytes(8, "little"), value)
        yield (*key, f"{value:016x}")

    return folds.by_key(levels(orders).withColumn("rank", better()), ["symbol"], ["side", "rank"], fold, "symbol string, fingerprint string")


def canonical(prints: DataFrame) -> DataFrame:
    """(books, fingerprint): one FNV-1a over the number of books, and each one's symbol and fingerprint, by symbol."""

    def fold(key, rows):
        books, value = 0, None
        for r in rows:
            if r.symbol is None:
                books, value = r.books, hashes.fnv1a(int(r.books).to_bytes(8, "little"))
            else:
                value = hashes.fnv1a(int(r.fingerprint, 16).to_bytes(8, "little"), hashes.fnv1a(r.symbol.encode(), value))
        yield books, f"{value:016x}"

    count = prints.agg(F.count("*").alias("books")).select(F.lit(0).alias("one"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("fingerprint"), "books")
    rows = prints.select(F.lit(0).alias("one"), "symbol", "fingerprint", F.lit(None).cast("long").alias("books"))
    return folds.by_key(count.unionByName(rows), ["one"], ["symbol"], fold, "books bigint, fingerprint string")


def lived(messages: DataFrame, first: str, last: str, step: str) -> DataFrame:
    """(at, symbol, side, order_id, px_raw, size, state, ts): the orders that lived at each of the times, before their messages.

    Times go from first to last by step (year or month). Each order tells for
    itself at which of them it lived, so there is no join of orders with times.
    """
    kind = dict(messages.dtypes)["ts"]
    end = F.least(F.coalesce("until", F.lit(last).cast(kind)), F.lit(last).cast(kind))
    on = F.trunc("ts", step)
    next_on = F.add_months(on, 12 if step == "year" else 1)
    start = F.greatest(next_on, F.lit(first).cast("date"))
    spans = journal(messages).where("live").withColumns({"a": start.cast("date"), "b": F.trunc(end, step)}).where("a <= b")
    at = F.explode(F.expr(f"sequence(a, b, interval 1 {step})"))
    return spans.select(at.alias("at"), "symbol", "side", "order_id", "px_raw", F.col("left").alias("size"), "state", F.col("placed").alias("ts"))


def top_at(messages: DataFrame, first: str, last: str) -> DataFrame:
    """(symbol, month, best_bid, best_ask, live_orders): the top of the book at the start of each month, before its messages; maxima are combined before the shuffle."""
    kind = dict(messages.dtypes)["ts"]
    bid, ask = F.when(F.col("side") == "B", F.col("px_raw")), F.when(F.col("side") == "S", F.col("px_raw"))
    return lived(messages, first, last, "month").groupBy("symbol", F.col("at").cast(kind).alias("month")).agg(F.max(bid).alias("best_bid"), F.min(ask).alias("best_ask"), F.count("*").alias("live_orders"))


def tops(messages: DataFrame, piece: Column | None = None) -> DataFrame:
    """(symbol, n, ts, tag, best_bid, best_ask): the top of the book after each applied message, n from 0 by symbol.

    Time is cut into pieces (months, unless piece tells otherwise). Each piece
    of a symbol starts from the levels that were left before it, which are sums
    of what all earlier pieces added, and is followed by itself: a symbol's
    prices with their orders are the state, and heaps of prices that drop what
    is gone when they meet it.
    """
    ts = dict(messages.dtypes)["ts"]
    added = F.when(F.col("tag") == "A", 1).when(F.col("live"), 0).otherwise(-1).cast("long")
    month = F.trunc("ts", "month") if piece is None else piece
    rows = shared.cut(journal(messages).where("outcome = 'ok' AND px_raw IS NOT NULL").select("symbol", month.alias("piece"), *tables.ORDER, "order_id", "tag", "side", "px_raw", added.alias("orders")))
    level = Window.partitionBy("symbol", "side", "px_raw").orderBy("piece")
    changed = rows.groupBy("symbol", "side", "px_raw", "piece").agg(F.sum("orders").alias("change"), F.count("*").alias("rows"))
    held = changed.select("symbol", "side", "px_raw", "piece", F.sum("change").over(level).alias("orders"), F.lead("piece").over(level).alias("next")).where("orders > 0")
    numbers = changed.groupBy("symbol", "piece").agg(F.sum("rows").alias("rows"))
    starts = numbers.select("symbol", "piece", F.coalesce(F.sum("rows").over(Window.partitionBy("symbol").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("orders"))
    later = numbers.select(F.col("symbol").alias("s"), F.col("piece").alias("p"))
    opened = held.join(later, (F.col("symbol") == F.col("s")) & (F.col("p") > F.col("piece")) & (F.col("next").isNull() | (F.col("p") <= F.col("next")))).select("symbol", F.col("p").alias("piece"), "side", "px_raw", "orders")
    bare = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in ("symbol", "piece", "orders")}
    before = opened.withColumns({c: x for c, x in bare.items() if c not in ("side", "px_raw")}).unionByName(starts.withColumns(bare))

    def fold(key, rows):
        sizes, heaps, n = {}, {"B": [], "S": []}, 0
        for r in rows:
            if r.side is None:
                n = r.orders
                continue
            level = (r.side, r.px_raw)
            if level not in sizes:
                sizes[level] = 0
                heapq.heappush(heaps[r.side], -r.px_raw if r.side == "B" else r.px_raw)
            sizes[level] += r.orders
            if r.tag is None:
                continue
            best = {}
            for side, heap in heaps.items():
                while heap and not sizes[side, abs(heap[0])]:
                    del sizes[side, abs(heapq.heappop(heap))]
                best[side] = abs(heap[0]) if heap else None
            yield (key[0], n, r.ts, r.tag, best["B"], best["S"])
            n += 1

    order = ["ts", "kind", "order_id", "line", "part", "supp"]
    return folds.by_key(before.unionByName(rows), ["symbol", "piece"], order, fold, f"symbol string, n bigint, ts {ts}, tag string, best_bid bigint, best_ask bigint")


def slots(levels: DataFrame, floor: int, tick: int, slots: int) -> DataFrame:
    """levels with slot, the place in a dense ladder from floor on; null for prices outside it or between ticks."""
    off = F.col("px_raw") - floor
    inside = (off >= 0) & (off % tick == 0) & (F.expr(f"(px_raw - {floor}) DIV {tick}") < slots)
    return levels.withColumn("slot", F.when(inside, F.expr(f"(px_raw - {floor}) DIV {tick}")))


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, counted as often as they stand there; have: which one has it."""
    return one.exceptAll(other).withColumn("have", F.lit("one")).unionByName(other.exceptAll(one).withColumn("have", F.lit("other")))
