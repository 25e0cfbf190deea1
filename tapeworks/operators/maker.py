"""A market maker on the top of the book, and the model of a resting order's fills.

Position feeds back into the quotes, so both are folds by symbol. All that
follows from fills (markouts, profit) is left to the operators of series.
"""

import math
from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import folds
from .series import raw_volatility

#: Risk aversion, order arrival, horizon in ticks, size, most inventory, least spread and edge (raw).
PARAMETERS = {"gamma": 0.0025, "k": 1.5, "horizon": 250.0, "size": 10, "most": 500, "spread": 100, "edge": 1}
MADE = "symbol string, n bigint, mid_raw bigint, bid bigint, ask bigint, bid_live boolean, ask_live boolean, fill string, position bigint, cash bigint"


def risk_term(sigma, gamma: float, horizon: float):
    return gamma * sigma * sigma * horizon


def depth_offset(size: Column, base: int, k: float, most: int = 100_000) -> Column:
    """What a queue of size shares at the best price adds to an offset, against one of base shares."""
    held = F.least(F.greatest(size, F.lit(1)), F.lit(most))
    return F.when(size.isNotNull(), (F.ln(held) - math.log(min(max(base, 1), most))) / k)


def model_quotes(rows: DataFrame, gamma: float = 0.0025, k: float = 1.5, spread: int = 100, horizon: float = 250.0, reservation: int = 0, base: int = 10) -> DataFrame:
    """rows (sigma, mid_raw, inventory, bid_size, ask_size) with bid and ask (raw): about the mid less what inventory costs.

    Prices are rounded half away from zero; bid_size and ask_size null: no depth term.
    """
    risk = risk_term(F.col("sigma"), gamma, horizon)
    half = F.greatest(0.5 * (0.5 * risk + math.log1p(gamma / k) / gamma), F.lit(0.5 * spread))
    middle = F.col("mid_raw") - (F.col("inventory") - reservation) * risk
    offsets = [half + F.coalesce(depth_offset(F.col(c), base, k), F.lit(0.0)) for c in ("bid_size", "ask_size")]
    return rows.withColumn("bid", F.round(middle - offsets[0]).cast("long")).withColumn("ask", F.round(middle + offsets[1]).cast("long"))


def nearest(x: float) -> int:
    """Half away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


class Volatility:
    """Root mean square of the last returns, each held within four times their median size; sizes are kept sorted."""

    def __init__(self, window: int = 256):
        self.last, self.sizes, self.window, self.mid = deque(), [], window, None

    def see(self, mid: int) -> float:
        if self.mid is not None:
            self.last.append(mid - self.mid)
            insort(self.sizes, abs(mid - self.mid))
            if len(self.last) > self.window:
                del self.sizes[bisect_left(self.sizes, abs(self.last.popleft()))]
        self.mid = mid
        n = len(self.last)
        if n < 2:
            return 0.0
        cap = 4 * self.sizes[n // 2]
        return math.sqrt(sum(min(x, cap) ** 2 if cap else x * x for x in self.sizes) / n)


def made(tops: DataFrame, parameters: dict = PARAMETERS) -> DataFrame:
    """MADE: the maker's quotes and fills at each two-sided top of (symbol, n, best_bid, best_ask).

    Its quote is never better than the book's. With a quote standing from
    before, the new bid fills when the best bid is at or below it, else the ask
    likewise: one fill at a time, of the fixed size. Volatility does not depend
    on the position and is worked out by pieces; only the position is a fold.
    """
    p = parameters
    base = math.log1p(p["gamma"] / p["k"]) / p["gamma"]

    def fold(key, rows):
        position, cash, standing = 0, 0, False
        for r in rows:
            mid = r.mid_raw
            risk = risk_term(r.raw, p["gamma"], p["horizon"])
            half = max(0.5 * (0.5 * risk + base), 0.5 * p["spread"])
            middle = mid - position * risk
            model = nearest(middle - half), nearest(middle + half)
            bid, ask = min(model[0], r.best_bid), max(model[1], r.best_ask)
            valid = model[1] > model[0]
            live = {"B": valid and position < p["most"], "S": valid and position > -p["most"]}
            fill = None
            if standing:
                fill = "B" if live["B"] and r.best_bid <= bid else "S" if live["S"] and r.best_ask >= ask else None
            if fill:
                sign = 1 if fill == "B" else -1
                position += sign * p["size"]
                cash -= sign * p["size"] * (bid if fill == "B" else ask)
            standing = valid and ask - bid >= p["edge"] and any(live.values())
            yield (*key, r.seq, mid, bid, ask, live["B"], live["S"], fill, position, cash)

    mid = F.expr("shiftright(best_bid + best_ask, 1)")
    both = cut(tops.where("best_bid IS NOT NULL AND best_ask IS NOT NULL").select("symbol", F.col("n").alias("seq"), mid.alias("mid_raw"), "best_bid", "best_ask"))
    return folds.by_key(raw_volatility(both, keep=("best_bid", "best_ask")), ["symbol"], ["seq"], fold, MADE)


def queue_fills(events: DataFrame, latency: int) -> DataFrame:
    """(placement, n, filled, ahead): what each event fills of a resting order, and the shares still ahead of it.

    events: (placement, n, ts, event, px_raw, qty, ahead). place sets the price,
    size and the shares ahead; trade at its price takes those ahead first and
    then fills it, once latency has passed; cancel takes from those ahead.
    """

    def fold(key, rows):
        price = left = ahead = since = None
        for r in rows:
            filled = 0
            if r.event == "place":
                price, left, ahead, since = r.px_raw, r.qty, r.ahead, r.ts
            elif price is not None and r.event == "cancel":
                ahead = max(ahead - r.qty, 0)
            elif price is not None and r.px_raw == price:
                taken = min(r.qty, ahead)
                ahead -= taken
                if ahead == 0 and r.ts >= since + latency:
                    filled = min(r.qty - taken, left)
                    left -= filled
            yield (*key, r.n, filled, ahead)

    rows = events.select("placement", "n", "ts", "event", "px_raw", "qty", "ahead")
    return folds.by_key(rows, ["placement"], ["n"], fold, "placement bigint, n bigint, filled bigint, ahead bigint")
