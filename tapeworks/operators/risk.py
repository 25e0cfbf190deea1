"""Pre-trade checks, rate limits, and audits of order states."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import folds

#: Default limits, in shares, raw price (1/10000) and orders a second.
LIMITS = {"order_notional": 500_000_000, "band": 10_000, "position": 50_000, "gross": 50_000, "rate": 1_000}
MOST = 2**63 - 1
#: The states in which an order is over.
FINAL_STATES = ["filled", "cancelled", "rejected"]
#: The states that each state may be followed by.
NEXT_STATES = {
    "pending_new": ["working", "rejected", "filled", "partially_filled", "cancelled"],
    "working": ["partially_filled", "filled", "pending_cancel", "pending_replace", "cancelled"],
    "partially_filled": ["partially_filled", "filled", "pending_cancel", "cancelled"],
    "pending_cancel": ["partially_filled", "filled", "cancelled", "rejected"],
    "pending_replace": ["partially_filled", "filled", "cancelled", "rejected", "working"],
}


def verdicts(orders: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """orders (symbol, seq, price, qty, reference, kill, held) with status: the first check that fails, in fixed order.

    held is the position before the order, in shares; gross limits and rates
    are not among these checks (see token_bucket for rates).
    """
    notional = F.try_multiply("price", "qty")
    status = (
        F.when(F.col("kill"), "kill_switch")
        .when(F.col("qty") == 0, "order_notional")
        .when(F.col("reference").isNull(), "no_reference_price")
        .when(F.abs(F.col("price") - F.col("reference")) > limits["band"], "price_band")
        .when(notional.isNull() | (notional > limits["order_notional"]), "order_notional")
        .when(F.col("held") + F.col("qty") > limits["position"], "position_limit")
        .otherwise("ok")
    )
    return orders.select("symbol", "seq", notional.alias("notional"), status.alias("status"))


class Bucket:
    """Holds rate * multiple tokens in millionths; whole microseconds refill it, and a clock that goes back refills nothing."""

    def __init__(self, rate: int, multiple: int = 1):
        self.rate, self.full = rate, rate * multiple * 1_000_000
        self.left, self.at = self.full, None

    def take(self, ts_us: int) -> bool:
        if self.at is None or ts_us > self.at:
            self.left = min(self.full, self.left + (ts_us - (ts_us if self.at is None else self.at)) * self.rate)
            self.at = ts_us
        ok = self.left >= 1_000_000
        self.left -= 1_000_000 * ok
        return ok


def token_bucket(orders: DataFrame, rate: int, multiple: int = 1) -> DataFrame:
    """(symbol, seq, allowed): a bucket for each symbol, a fold in time order."""

    def fold(key, rows):
        bucket = Bucket(rate, multiple)
        for r in rows:
            yield (*key, r.seq, bucket.take(r.ts_us))

    return folds.by_key(orders.select("symbol", "seq", "ts_us"), ["symbol"], ["seq"], fold, "symbol bigint, seq bigint, allowed boolean")


class Account:
    """An account's checks in their fixed order. Positions are shares by side; taking back stops at none."""

    def __init__(self, limits: dict):
        self.limits, self.bucket = limits, Bucket(limits["rate"])
        self.held = {"B": 0, "S": 0}
        self.killed = False

    def fill(self, side: str, qty: int) -> None:
        self.held[side] += qty

    def unfill(self, side: str, qty: int) -> None:
        self.held[side] = max(self.held[side] - qty, 0)

    def check(self, side: str, price: int, qty: int, reference: int | None, ts_us: int) -> str:
        """ok, or the first check that fails; only an order that passes all others takes a token."""
        notional, limits = price * qty, self.limits
        failures = (
            ("kill_switch", lambda: self.killed),
            ("order_notional", lambda: qty == 0),
            ("no_reference_price", lambda: reference is None),
            ("price_band", lambda: abs(price - reference) > limits["band"]),
            ("order_notional", lambda: notional > min(limits["order_notional"], MOST)),
            ("position_limit", lambda: self.held[side] + qty > limits["position"]),
            ("gross_limit", lambda: sum(self.held.values()) + qty > limits["gross"]),
            ("rate_limit", lambda: not self.bucket.take(ts_us)),
        )
        return next((name for name, fails in failures if fails()), "ok")


def checked(events: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """(account, seq, status, bid_shares, ask_shares): all checks of each account's events in order of seq.

    events: (account, seq, ts_us, event, side, price, qty, reference). event is
    order, fill, unfill, kill or reset; status is null for all but orders.
    """

    def fold(key, rows):
        account = Account(limits)
        for r in rows:
            status = None
            if r.event == "order":
                status = account.check(r.side, r.price, r.qty, r.reference, r.ts_us)
            elif r.event in ("fill", "unfill"):
                (account.fill if r.event == "fill" else account.unfill)(r.side, r.qty)
            else:
                account.killed = r.event == "kill"
            yield (*key, r.seq, status, account.held["B"], account.held["S"])

    rows = events.select("account", "seq", "ts_us", "event", "side", "price", "qty", "reference")
    return folds.by_key(rows, ["account"], ["seq"], fold, "account bigint, seq bigint, status string, bid_shares bigint, ask_shares bigint")


def transitions(states: DataFrame) -> DataFrame:
    """(from_state, to_state, legal, n) over consecutive states of (key, seq, state)."""
    w = Window.partitionBy("key").orderBy("seq")
    pairs = states.select(F.lag("state").over(w).alias("from_state"), F.col("state").alias("to_state")).where("from_state IS NOT NULL")
    legal = states.sparkSession.createDataFrame([(a, b) for a, x in NEXT_STATES.items() for b in x], "from_state string, to_state string").withColumn("legal", F.lit(True))
    counted = pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(legal), ["from_state", "to_state"], "left").select("from_state", "to_state", F.coalesce("legal", F.lit(False)).alias("legal"), "n")
