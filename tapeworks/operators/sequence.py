"""Integrity of numbered streams: gaps and repetitions against the number expected next."""

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import folds
from .prefix import before


def by_arrival() -> WindowSpec:
    return Window.partitionBy("session").orderBy("arrival")


def audited(stream: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(session, arrival, observed, expected, state, missing): the first message sets the base."""
    seen = before(stream.select("session", "arrival", "observed"), {"most": ("observed", "max")}, bucket, "session", "arrival")
    rows = seen.withColumn("expected", F.coalesce(F.col("most") + 1, F.col("observed")))
    state = F.when(F.col("observed") == F.col("expected"), "ok").when(F.col("observed") > F.col("expected"), "gap").otherwise("duplicate")
    return rows.select("session", "arrival", "observed", "expected", state.alias("state"), F.greatest(F.col("observed") - F.col("expected"), F.lit(0).cast("long")).alias("missing"))


def resynced(stream: DataFrame, rebase: bool = False) -> DataFrame:
    """(session, resyncs, accepted, missing, gaps, rejects, clean) of (session, arrival, observed, resync).

    A resync before a message is only counted; with rebase it also makes that
    message's number the one that was expected.
    """
    so_far = by_arrival().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = stream.withColumn("part", F.sum(F.col("resync").cast("long")).over(so_far) if rebase else F.lit(0).cast("long"))
    w = Window.partitionBy("session", "part").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("expected", F.coalesce(F.max(F.col("observed") + 1).over(w), F.col("observed")))
    gap = F.greatest(F.col("observed") - F.col("expected"), F.lit(0))
    late = F.count_if(F.col("observed") < F.col("expected"))
    missing = F.sum(gap)
    return seen.groupBy("session").agg(F.count_if("resync").alias("resyncs"), F.count_if(F.col("observed") >= F.col("expected")).alias("accepted"), missing.alias("missing"), F.count_if(gap > 0).alias("gaps"), late.alias("rejects"), ((missing == 0) & (late == 0)).alias("clean"))


def audited_packets(packets: DataFrame) -> DataFrame:
    """(session, arrival, first, n, expected, state, missing): packets of n messages from number first on.

    A packet without messages is judged but moves nothing, and neither does a
    duplicate, even one that reaches past what is expected; so this is a fold.
    """

    def judge(key, rows):
        following = None
        for r in rows:
            want = r.first if following is None else following
            state = "ok" if r.first == want else "gap" if r.first > want else "duplicate"
            if r.n and state != "duplicate":
                following = r.first + r.n
            yield (*key, r.arrival, r.first, r.n, want, state, max(r.first - want, 0))

    return folds.by_key(packets.select("session", "arrival", "first", "n"), ["session"], ["arrival"], judge, "session bigint, arrival bigint, first bigint, n bigint, expected bigint, state string, missing bigint")


def totals(stream: DataFrame) -> DataFrame:
    a = audited(stream)
    return a.groupBy("session").agg(F.count_if(F.col("state") != "duplicate").alias("accepted"), F.sum("missing").alias("missing"), F.count_if(F.col("state") == "gap").alias("gaps"), F.count_if(F.col("state") == "duplicate").alias("rejects"), (F.count_if(F.col("state") != "ok") == 0).alias("clean"))


def lag_by_shard(stream: DataFrame) -> DataFrame:
    """(session, lag): how far each session's last arrival is behind the last of all."""
    last = stream.groupBy("session").agg(F.max("arrival").alias("seen"))
    return last.select("session", (F.max("seen").over(Window.partitionBy()) - F.col("seen")).alias("lag"))


def clock_offsets(samples: DataFrame, step_over: int) -> DataFrame:
    """(source, seq, offset, drift_ppb, stepped): offsets of (local, remote) clocks and drift since the first sample."""
    w = Window.partitionBy("source").orderBy("seq")
    s = samples.select("source", "seq", "local", (F.col("remote") - F.col("local")).alias("offset"))
    s = s.withColumns({"offset0": F.first("offset").over(w), "local0": F.first("local").over(w), "last": F.lag("offset").over(w)})
    drift = F.expr("CASE WHEN local > local0 THEN (offset - offset0) * 1000000000 DIV (local - local0) ELSE 0 END")
    return s.select("source", "seq", "offset", drift.alias("drift_ppb"), F.coalesce(F.abs(F.col("offset") - F.col("last")) > step_over, F.lit(True)).alias("stepped"))
