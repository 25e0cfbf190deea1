"""What several of these operators need from Spark."""

import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import cut
from . import text

#: Steps of a plan under which a file's row is still one row.
PLAIN = {"Project", "Filter", "Relation", "SubqueryAlias", "GlobalLimit", "LocalLimit", "LogicalRelation"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Long texts go to Python in batches of so many rows, so that a worker's memory stays small; a setting of one's own that is lower stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    return shared.folder(spark)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def with_rows(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a number for each row, the same whenever docs is computed again; doc_id need be neither unique nor there.

    Rows of files are numbered by place in their file from a hash of its name
    on (below 2**62, so that files of a million rows overlap as good as never),
    whoever reads them in whatever splits. Any other docs are numbered and
    written to the shared folder first.
    """
    steps = re.findall(r"^[ :+-]*(\w+)", docs._jdf.queryExecution().analyzed().toString(), re.M)
    if set(steps) <= PLAIN and "_metadata" not in docs.columns:
        place = F.shiftrightunsigned(F.xxhash64(F.col("_metadata.file_path")), 2) + F.col("_metadata.row_index")
        try:
            return docs.select("*", place.alias(name))
        except AnalysisException:  # files of a format that doesn't number its rows
            pass
    return cut(docs.select("*", F.monotonically_increasing_id().alias(name)))


def without(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """docs, which has rows numbered by name, less the rows in gone (row), with its own columns."""
    return docs.join(gone.select(F.col("row").alias(name)), name, "left_anti").drop(name)


def bitmap(hashes: DataFrame, column: str, bits_each: int = 16, least: int = 24, most: int = 30) -> Broadcast:
    """A bitmap with a bit for each 64-bit hash, for text.may_hold().

    It has about bits_each bits for each hash, but at most 2**most. Executors
    fold the hashes into words of 64 bits, and the driver gets those: 2**(most - 6)
    at most, however many hashes there are. Past that bound more and more
    hashes that were not put in seem to be there, which callers must bear.
    """
    hashes = cut(hashes.select(column))
    bits = min(most, max(least, (bits_each * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    folded = hashes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")).alias("set"))
    held = folded.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[held["word"].to_numpy()] = held["set"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def id_hashes(column: pa.Array) -> np.ndarray:
    return text.mix(column.fill_null(0).to_numpy().view(np.uint64))


def id_bitmap(ids: DataFrame) -> Broadcast:
    """A bitmap of the values of the one column of ids, a bigint."""

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(text.signed(id_hashes(b.column(0))))], ["h"])

    return bitmap(ids.mapInArrow(hashed, "h bigint"), "h")


def with_ids(known: Broadcast, wanted: bool):
    """Task function: the rows whose first column may be in the bitmap, or those whose cannot."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(text.may_hold(known.value, id_hashes(b.column(0))) == wanted))

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the least node reachable, by alternating large and small stars.

    Each round is a few shuffles with map-side aggregation and no collected
    neighbour lists; it ends when a round changes no edge. Rounds are cut in
    the shared folder.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = now
    seen = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n")).select(F.col("b").alias("x"), "n", "m")
        now = cut(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).union(small.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    members = nodes.select(F.col("a").alias("node")).union(nodes.select("b")).distinct()
    return members.join(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
