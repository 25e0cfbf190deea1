"""An order manager's life of orders: events by account in order, each judged against the legal states."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds
from .risk import FINAL_STATES, LIMITS, NEXT_STATES, Account

FINAL = set(FINAL_STATES)
#: The state that a venue's or a user's event asks for.
ASKS = {"ack": "working", "reject": "rejected", "cancel": "pending_cancel", "replace": "pending_replace", "cancel_ack": "cancelled", "replace_ack": "working"}
MANAGED = "account bigint, seq bigint, slot bigint, event string, status string, state string, leaves bigint, price bigint, original bigint"


@dataclass
class Order:
    side: str
    price: int
    original: int
    leaves: int
    state: str = "pending_new"

    def may(self, state: str) -> bool:
        return state in NEXT_STATES.get(self.state, ())


def asked(order: Order, event: str, price: int, qty: int) -> str:
    """What an event other than a fill does to an order: ok, or why it does nothing."""
    if event in ("cancel", "replace"):
        if order.state in FINAL:
            return "not_live"
        if event == "cancel" and not order.leaves:
            return "nothing_to_cancel"
    if not order.may(ASKS[event]):
        return "illegal_transition"
    order.state = ASKS[event]
    if event == "replace":
        order.price, order.original = price, qty
    if order.state in FINAL:
        order.leaves = 0
    return "ok"


def filled(order: Order, account: Account, qty: int) -> str:
    """A partial fill counts against the account and the order even where the state may not follow."""
    if order.state in FINAL or not 0 < qty <= order.leaves:
        return "illegal_transition"
    account.fill(order.side, qty)
    order.leaves -= qty
    state = "partially_filled" if order.leaves else "filled"
    if order.leaves and not order.may(state):
        return "illegal_transition"
    order.state = state
    return "ok"


def managed(events: DataFrame, limits: dict = LIMITS, pool: int = 1024) -> DataFrame:
    """MANAGED: each event with its status and the order's state after it.

    events: (account, seq, ts_us, slot, event, side, price, qty, reference).
    event is submit, ack, reject, fill, cancel, replace, cancel_ack,
    replace_ack or kill. A submit passes the account's checks first; a slot
    whose order is over may be taken again; kill cancels every live order and
    tells each as a row of its own.
    """

    def fold(key, rows):
        account, orders = Account(limits), {}

        def told(r, slot, status):
            o = orders.get(slot)
            return (*key, r.seq, slot, r.event, status, *((o.state, o.leaves, o.price, o.original) if o else (None,) * 4))

        for r in rows:
            order = orders.get(r.slot)
            if r.event == "kill":
                account.killed = True
                for slot, o in orders.items():
                    if o.state not in FINAL:
                        o.state, o.leaves = "cancelled", 0
                        yield told(r, slot, "ok")
            elif r.event == "submit":
                status = account.check(r.side, r.price, r.qty, r.reference, r.ts_us)
                live = sum(o.state not in FINAL for o in orders.values())
                if status == "ok" and (live >= pool or (order and order.state not in FINAL)):
                    status = "pool_full"
                if status == "ok":
                    orders[r.slot] = Order(r.side, r.price, r.qty, r.qty)
                yield told(r, r.slot, status)
            elif order is None:
                yield told(r, r.slot, "unknown_order")
            else:
                yield told(r, r.slot, filled(order, account, r.qty) if r.event == "fill" else asked(order, r.event, r.price, r.qty))

    rows = events.select("account", "seq", "ts_us", "slot", "event", "side", "price", "qty", "reference")
    return folds.by_key(rows, ["account"], ["seq"], fold, MANAGED)


def reconciled(rows: DataFrame) -> DataFrame:
    """(state, orders, leaves): orders by the state they are left in."""
    last = rows.where("state IS NOT NULL").groupBy("account", "slot").agg(F.max_by(F.struct("state", "leaves"), "seq").alias("o"))
    return last.groupBy("o.state").agg(F.count("*").alias("orders"), F.sum("o.leaves").alias("leaves"))
