"""SQL for DuckDB of folds that feed back on themselves: one recursion step for each message of a key."""

from ..operators import risk
from ..sources import tables

OBS = f"obs AS ({tables.OBS_DUCK})"

BUCKET = f"""WITH RECURSIVE {OBS}, o AS (SELECT symbol, seq, ts_us, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS rn FROM obs),
b AS (
  SELECT symbol, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(1000000 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS told, false AS allowed FROM o WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, seq, full_now - CASE WHEN full_now >= 1000000 THEN 1000000 ELSE 0 END, greatest(ts_us, coalesce(told, ts_us)), full_now >= 1000000
  FROM (SELECT o.symbol, o.rn, o.seq, o.ts_us, b.told, least(1000000, b.rest + greatest(o.ts_us - coalesce(b.told, o.ts_us), 0)) AS full_now FROM b JOIN o ON o.symbol = b.symbol AND o.rn = b.rn + 1) x
)
SELECT symbol, seq, allowed FROM b WHERE rn > 0"""


def flow(kinds: list[str], qty: str = "event_id % 401", where: str = "true") -> str:
    """Events by account, with orders about the account's previous price, numbered by account."""
    chosen = "[" + ", ".join(f"'{k}'" for k in kinds) + "]"
    return f"""e AS (SELECT user_id % 16 AS account, event_id AS seq, epoch_us(ts) AS ts_us, CASE WHEN event_id % 1500 = 1499 THEN 'kill' WHEN event_id % 1500 < 16 THEN 'reset' ELSE {chosen}[1 + (event_id // 16) % {len(kinds)}] END AS event,
  CASE WHEN event_id // 3 % 2 = 0 THEN 'B' ELSE 'S' END AS side, 1000000 + 100 * CAST(round(value) AS BIGINT) AS price, event_id % 401 AS whole, event_id % 5 AS slot,
  lag(1000000 + 100 * CAST(round(value) AS BIGINT)) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS reference FROM events),
f AS (SELECT * REPLACE (CASE WHEN event = 'fill' THEN {qty.replace('event_id % 401', 'whole')} ELSE whole END AS whole), row_number() OVER (PARTITION BY account ORDER BY seq) AS rn FROM e WHERE {where})"""


def check(limits: dict, order: str) -> str:
    """The first check that an order fails, but the rate: ok if none; killed, held_b and held_s are the account's."""
    return f"""CASE WHEN NOT {order} THEN NULL WHEN killed THEN 'kill_switch' WHEN qty = 0 THEN 'order_notional' WHEN reference IS NULL THEN 'no_reference_price'
      WHEN abs(price - reference) > {limits['band']} THEN 'price_band' WHEN price * qty > {limits['order_notional']} THEN 'order_notional'
      WHEN CASE side WHEN 'B' THEN held_b ELSE held_s END + qty > {limits['position']} THEN 'position_limit' WHEN held_b + held_s + qty > {limits['gross']} THEN 'gross_limit' ELSE 'ok' END"""


def tokens(limits: dict) -> str:
    """What the account's bucket would hold at a message's time."""
    return f"least({limits['rate']} * 1000000, rest + greatest(ts_us - coalesce(told, ts_us), 0) * {limits['rate']})"


ACCOUNT = "false AS killed, CAST(0 AS BIGINT) AS held_b, CAST(0 AS BIGINT) AS held_s, CAST({rate} * 1000000 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS told"


def checked(limits: dict, kinds: list[str]) -> str:
    return f"""WITH RECURSIVE {flow(kinds)},
r AS (
  SELECT account, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS status, {ACCOUNT.format(rate=limits['rate'])} FROM f WHERE rn = 1
  UNION ALL
  SELECT account, rn, seq, CASE WHEN status = 'ok' AND full_now < 1000000 THEN 'rate_limit' ELSE status END,
    CASE event WHEN 'kill' THEN true WHEN 'reset' THEN false ELSE killed END,
    CASE WHEN side = 'B' AND event = 'fill' THEN held_b + qty WHEN side = 'B' AND event = 'unfill' THEN greatest(held_b - qty, 0) ELSE held_b END,
    CASE WHEN side = 'S' AND event = 'fill' THEN held_s + qty WHEN side = 'S' AND event = 'unfill' THEN greatest(held_s - qty, 0) ELSE held_s END,
    CASE WHEN status = 'ok' THEN full_now - CASE WHEN full_now >= 1000000 THEN 1000000 ELSE 0 END ELSE rest END,
    CASE WHEN status = 'ok' THEN greatest(ts_us, coalesce(told, ts_us)) ELSE told END
  FROM (SELECT *, {check(limits, "(event = 'order')")} AS status, {tokens(limits)} AS full_now
    FROM (SELECT f.account, f.rn, f.seq, f.ts_us, f.event, f.side, f.price, f.whole AS qty, f.reference, r.killed, r.held_b, r.held_s, r.rest, r.told FROM r JOIN f ON f.account = r.account AND f.rn = r.rn + 1) x) y
)
SELECT account, seq, status, held_b AS bid_shares, held_s AS ask_shares FROM r WHERE rn > 0"""


FINAL = ", ".join(f"'{s}'" for s in risk.FINAL_STATES)
ASKS = {"ack": "working", "reject": "rejected", "cancel": "pending_cancel", "replace": "pending_replace", "cancel_ack": "cancelled", "replace_ack": "working"}
TARGET = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASKS.items()) + " WHEN 'fill' THEN CASE WHEN cur.leaves > qty THEN 'partially_filled' ELSE 'filled' END END"
MAY = "coalesce(CASE cur.state " + " ".join(f"WHEN '{a}' THEN target IN ({', '.join(repr(b) for b in x)})" for a, x in risk.NEXT_STATES.items()) + " END, false)"


def managed(limits: dict, kinds: list[str]) -> str:
    """Slots as a list of five orders; a kill tells every order that was live."""
    order = "{'state': %s, 'side': %s, 'price': %s, 'original': %s, 'leaves': %s}"
    bare = order % ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)")
    changed = f"""CASE WHEN event = 'submit' AND status = 'ok' THEN {order % ("'pending_new'", 'side', 'price', 'qty', 'qty')}
      WHEN event = 'fill' AND moves THEN {order % ("CASE WHEN status = 'ok' THEN target ELSE cur.state END", 'cur.side', 'cur.price', 'cur.original', 'cur.leaves - qty')}
      WHEN status = 'ok' AND event <> 'submit' THEN {order % ('target', 'cur.side', "CASE WHEN event = 'replace' THEN price ELSE cur.price END", "CASE WHEN event = 'replace' THEN qty ELSE cur.original END", f"CASE WHEN target IN ({FINAL}) THEN 0 ELSE cur.leaves END")} ELSE cur END"""
    killed = order % ("'cancelled'", "x.side", "x.price", "x.original", "CAST(0 AS BIGINT)")
    return f"""WITH RECURSIVE {flow(kinds, "event_id % 401 % 60", "event <> 'reset'")},
r AS (
  SELECT account, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS status, {ACCOUNT.format(rate=limits['rate'])}, [{', '.join([bare] * 5)}] AS slots, [{', '.join([bare] * 5)}] AS before FROM f WHERE rn = 1
  UNION ALL
  SELECT account, rn, seq, slot, event, status, killed OR event = 'kill',
    CASE WHEN moves AND cur.side = 'B' THEN held_b + qty ELSE held_b END, CASE WHEN moves AND cur.side = 'S' THEN held_s + qty ELSE held_s END,
    CASE WHEN passed = 'ok' THEN full_now - CASE WHEN full_now >= 1000000 THEN 1000000 ELSE 0 END ELSE rest END, CASE WHEN passed = 'ok' THEN greatest(ts_us, coalesce(told, ts_us)) ELSE told END,
    CASE WHEN event = 'kill' THEN list_transform(slots, lambda x: CASE WHEN x.state IS NULL OR x.state IN ({FINAL}) THEN x ELSE {killed} END) ELSE list_transform(slots, lambda x, i: CASE WHEN i = slot + 1 THEN now ELSE x END) END, slots
  FROM (SELECT *, {changed} AS now FROM (SELECT *, CASE WHEN event = 'kill' THEN 'ok' WHEN event = 'submit' THEN CASE WHEN passed = 'ok' AND full_now < 1000000 THEN 'rate_limit' WHEN passed = 'ok' AND cur.state NOT IN ({FINAL}) THEN 'pool_full' ELSE passed END
      WHEN cur.state IS NULL THEN 'unknown_order' WHEN event = 'fill' THEN CASE WHEN moves AND (target = 'filled' OR {MAY}) THEN 'ok' ELSE 'illegal_transition' END
      WHEN event IN ('cancel', 'replace') AND cur.state IN ({FINAL}) THEN 'not_live' WHEN event = 'cancel' AND cur.leaves = 0 THEN 'nothing_to_cancel' WHEN {MAY} THEN 'ok' ELSE 'illegal_transition' END AS status
    FROM (SELECT *, {TARGET} AS target, coalesce(event = 'fill' AND cur.state NOT IN ({FINAL}) AND qty > 0 AND qty <= cur.leaves, false) AS moves, {check(limits, "(event = 'submit')")} AS passed, {tokens(limits)} AS full_now
      FROM (SELECT f.account, f.rn, f.seq, f.ts_us, f.event, f.side, f.price, f.whole AS qty, f.reference, f.slot, r.killed, r.held_b, r.held_s, r.rest, r.told, r.slots, r.slots[f.slot + 1] AS cur FROM r JOIN f ON f.account = r.account AND f.rn = r.rn + 1) a) b) c) d
),
m AS (SELECT account, seq, slot, event, status, slots[slot + 1] AS o FROM r WHERE rn > 0 AND event <> 'kill'
  UNION ALL SELECT account, seq, i, event, 'ok', slots[i + 1] FROM (SELECT *, unnest(range(5)) AS i FROM r WHERE rn > 0 AND event = 'kill') k WHERE before[i + 1].state NOT IN ({FINAL})),
managed AS (SELECT account, seq, slot, event, status, o.state AS state, o.leaves AS leaves, o.price AS price, o.original AS original FROM m)"""


def replaced(fold: str) -> str:
    """Orders that replaces connect as one list for each chain; all others by the fold of each order."""
    made = "{'id': %s, 'symbol': %s, 'side': %s, 'px': %s, 'size': %s, 'state': %s}"
    return f"""{fold}, u AS ({tables.REPLACES_DUCK}), edge AS (SELECT order_id AS a, new_id AS b FROM u UNION SELECT new_id, order_id FROM u),
reach AS (SELECT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
chain AS (SELECT a AS order_id, min(b) AS chain FROM reach GROUP BY a),
every AS (SELECT *, CAST(NULL AS BIGINT) AS new_id FROM m UNION ALL SELECT * FROM u),
told AS (SELECT chain, every.*, row_number() OVER (PARTITION BY chain ORDER BY ts, kind, order_id, line, part, supp) AS rn FROM every JOIN chain USING (order_id)),
run AS (
  SELECT chain, CAST(0 AS BIGINT) AS rn, list_filter([{made % ('CAST(0 AS BIGINT)', "''", "''", 'CAST(0 AS BIGINT)', 'CAST(0 AS BIGINT)', '0')}], lambda x: false) AS held FROM told WHERE rn = 1
  UNION ALL
  SELECT chain, rn, CASE WHEN tag = 'A' THEN CASE WHEN cur IS NULL AND order_id <> 0 AND qty > 0 THEN list_append(held, {made % ('order_id', 'symbol', 'side', 'px_raw', 'qty', '0')}) ELSE held END
    WHEN cur IS NULL OR tag IN ('E', 'C', 'X') AND qty > cur.size THEN held
    WHEN tag = 'U' AND new_id <> 0 AND qty > 0 AND len(list_filter(held, lambda x: x.id = new_id AND x.id <> order_id)) = 0 THEN list_append(list_filter(held, lambda x: x.id <> order_id), {made % ('new_id', 'cur.symbol', 'cur.side', 'px_raw', 'qty', '0')})
    WHEN tag IN ('U', 'D') OR qty = cur.size THEN list_filter(held, lambda x: x.id <> order_id)
    ELSE list_append(list_filter(held, lambda x: x.id <> order_id), {made % ('order_id', 'cur.symbol', 'cur.side', 'cur.px', 'cur.size - qty', "CASE WHEN tag = 'X' THEN 0 ELSE 1 END")}) END
  FROM (SELECT t.*, run.held, list_filter(run.held, lambda x: x.id = t.order_id)[1] AS cur FROM run JOIN told t ON t.chain = run.chain AND t.rn = run.rn + 1) z
),
last AS (SELECT unnest(held) AS o FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY rn DESC) AS back FROM run) x WHERE back = 1)
SELECT order_id, symbol, side, px_raw, size, state FROM live WHERE order_id NOT IN (SELECT order_id FROM chain)
UNION ALL SELECT o.id, o.symbol, o.side, o.px, o.size, o.state FROM last"""
