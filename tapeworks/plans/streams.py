"""Streaming queries: each runs over all that is there now, and gives what its batch form gives."""

from pyspark.sql import functions as F

from ..sources import tables
from ..streaming import replay
from .queries import ORACLES, query


def messages(spark, sf_dir):
    text = tables.MESSAGES.format(text="STRING", div="DIV", orders="{orders}", lineitem="{lineitem}")
    return spark.sql(text, orders=replay.read(spark, sf_dir, "orders"), lineitem=replay.read(spark, sf_dir, "lineitem"))


@query("st_levels", ORACLES["o05_levels"].replace("CAST(agg_size AS BIGINT) AS agg_size", "CAST(agg_size AS BIGINT) AS agg_size, CAST(order_count AS BIGINT) AS order_count"))
def st_levels(spark, sf_dir):
    return replay.levels(replay.finished(replay.level_changes(messages(spark, sf_dir)), "levels"))


AUDIT = """WITH a AS (SELECT user_id % 4 AS session, event_id AS arrival, event_id - event_id % 3 * (event_id % 50) AS observed FROM events),
e AS (SELECT *, coalesce(max(observed + 1) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), observed) AS expected FROM a)
SELECT *, CASE WHEN observed = expected THEN 'ok' WHEN observed > expected THEN 'gap' ELSE 'duplicate' END AS state, greatest(observed - expected, 0) AS missing FROM e"""


@query("st_sequence", AUDIT)
def st_sequence(spark, sf_dir):
    e = replay.read(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("session"), F.col("event_id").alias("arrival"), F.expr("event_id - event_id % 3 * (event_id % 50)").alias("observed"))
    return replay.audited(e)
