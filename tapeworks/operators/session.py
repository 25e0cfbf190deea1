"""A sequenced session's client: login, gaps that ask for retransmission, heartbeats and liveness."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import before

TOLD = "session bigint, n bigint, event string, state string, expected bigint, reply string, alive boolean"


def login_request(user: Column, password: Column) -> Column:
    """L, then user and password in ten characters each, as bytes."""
    return F.encode(F.concat(F.lit("L"), F.rpad(user, 10, " "), F.rpad(password, 10, " ")), "ISO-8859-1")


def followed(events: DataFrame, timeout_us: int, bucket: int = 1 << 16) -> DataFrame:
    """TOLD: the client's state after each event, what it replies (hex), and whether the other side was still alive.

    events: (session, n, ts_us, event, number), n whole and once by session.
    event is login, accepted, refused, message, done, heartbeat or logout;
    number is a message's or heartbeat's number, the last number at accepted,
    the next one at done. A gap asks for what is missing, at most 65,535, and
    moves nothing; until it is done no message is judged.

    Whether a session is idle, logging in, open or closed follows from its last
    event of four. Every accepted and done begins a span; in it an open session
    expects one more than the largest number so far, until the first message
    beyond that, which freezes what it expects. So all are running values, in
    buckets of n, and no session is one task's work.
    """
    kind, key = F.col("event"), "session"
    e = events.select(key, "n", "ts_us", "event", "number").withColumns({
        "turn": F.when(kind == "login", "logging_in").when(kind == "accepted", "open").when(kind == "refused", "idle").when(kind == "logout", "closed"),
        "told": F.when(kind.isin("message", "heartbeat"), F.struct(F.col("ts_us").alias("at"))).when(kind == "accepted", F.struct(F.lit(None).cast(dict(events.dtypes)["ts_us"]).alias("at"))),
        "begins": kind.isin("accepted", "done").cast("long"),
        "base": F.when(kind == "accepted", F.struct((F.col("number") + 1).alias("next"))).when(kind == "done", F.struct(F.col("number").alias("next"))),
    })
    seen = before(e, {"turned": ("turn", "last"), "heard": ("told", "last"), "began": ("begins", "sum"), "from": ("base", "last")}, bucket, key, "n")
    was = F.coalesce("turned", F.lit("idle"))
    # the event that begins a span belongs to it, with what it was before in "was"
    s = seen.withColumns({"was": was, "is": F.coalesce("turn", was), "span": F.struct(key, (F.col("began") + F.col("begins")).alias("no")), "start": F.coalesce("base", "from")["next"]})
    # only an open session judges: messages while it is not are no more than passing
    judged = (kind == "message") & (F.col("was") == "open")
    s = s.withColumn("judged", F.when(judged, F.col("number")))
    s = before(s, {"most": ("judged", "max")}, bucket, "span", "n").withColumn("due", F.greatest(F.col("most") + 1, "start"))
    s = s.withColumn("gap", F.when(F.col("judged") > F.col("due"), F.struct("due")))
    s = before(s, {"frozen": ("gap", "first")}, bucket, "span", "n")
    stuck = F.col("frozen").isNotNull()
    asks = F.col("gap").isNotNull() & ~stuck
    after = F.when(stuck, F.col("frozen")["due"]).when(~asks & (F.col("judged") == F.col("due")), F.col("due") + 1).otherwise(F.col("due"))
    state = F.when(F.col("is") != "open", F.col("is")).when(stuck | asks, "retransmitting").otherwise("ready")
    wide = lambda c, digits: F.lpad(F.lower(F.hex(c)), digits, "0")
    reply = F.when(kind == "heartbeat", F.concat(F.lit("48"), wide(F.col("number"), 16))).when(asks, F.concat(F.lit("52"), wide(F.col(key), 16), wide(F.col("due"), 16), wide(F.least(F.col("number") - F.col("due"), F.lit(0xFFFF)), 4))).otherwise("")
    last = F.col("heard")["at"]
    alive = F.when(F.col("was").isin("idle", "logging_in") | last.isNull(), F.col("was") != "idle").otherwise(F.col("ts_us") - last <= timeout_us)
    return s.select(key, "n", "event", state.alias("state"), after.alias("expected"), reply.alias("reply"), alive.alias("alive"))
