"""Quality classifier: random-indexing word vectors, pooled, under a small network.

Tokens are maximal runs of letters, of digits, or of other characters; each has
a word row (its hash) and a shape row (kind, case, length). Every row has a
fixed sparse random index vector. A row's context vector is the sum of the
index vectors of the tokens beside it, gathered over all documents. A document
is the mean of its tokens' context vectors and index vectors, and the share of
different tokens; a two-layer numpy network turns that into a probability,
calibrated by a temperature on rows it was not fitted on.

Labels are learned from at most `SAMPLE` rows whose crc32(doc_id as text) mod 3
is not 1; doc_id only chooses them and is no input of a score, nor are lang and
source.

Defined results: null and empty texts get the score of a vector of zeros; rows
with equal doc_id are scored each; labels that are null or of no document are
ignored; without labels of both kinds every score is the share of label 1, or
0.5 without any; extra columns are ignored.

Scale: context vectors are one table of `ROWS` rows whatever the vocabulary;
each task sums its own and Spark adds them up by row. Texts are never shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, learn, text

ROWS, SHAPES, DIMS, SAMPLE = 4096, 64, 24, 20_000
HELD_OUT, MODULUS, CUT = 1, 3, 0.5
#: Kinds of bytes: 0 space, 1 letter, 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[~text.NOT_LETTER] = 1
KIND[0x30:0x3A] = 2
KIND[text.SPACE] = 0


def index_vectors() -> np.ndarray:
    """Two entries of 1 and two of -1 in each row."""
    rng = np.random.default_rng(11)
    out = np.zeros((ROWS + SHAPES, DIMS), np.float32)
    for row in out:
        row[rng.permutation(DIMS)[:4]] = [1, 1, -1, -1]
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word row and shape row of each token, and each text's first token."""
    kind = KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(data)]
    kept = kind[start] > 0
    start, end = start[kept], end[kept]
    word = (text.hash_spans(data, start, end) % np.uint64(ROWS)).astype(np.int64)
    upper = np.r_[0, np.cumsum((data >= 0x41) & (data <= 0x5A))]
    caps, size = upper[end] - upper[start], end - start
    first_up = (data[start] >= 0x41) & (data[start] <= 0x5A) if len(start) else np.zeros(0, bool)
    case = np.where(caps == 0, 0, np.where(caps == size, 1, np.where(first_up & (caps == 1), 2, 3)))
    shape = (kind[start].astype(np.int64) * 4 + case) * 4 + np.minimum(3, size.astype(np.int64) // 3)
    return word, ROWS + shape % SHAPES, np.searchsorted(start, offsets)


def contexts():
    """Task function: (text) to (row, c0, c1, ...): this task's sums of context vectors."""
    index = index_vectors()
    where = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :4]
    sign = np.take_along_axis(index, where, 1)

    def run(batches):
        total = np.zeros((ROWS + SHAPES) * DIMS)
        for batch in batches:
            for c in text.chunks(batch.column(0)):
                word, shape, first = tokens(c.data, c.offsets)
                inside = np.ones(max(len(word) - 1, 0), bool)
                cuts = first[1:-1]
                inside[cuts[(cuts > 0) & (cuts < len(word))] - 1] = False
                left = np.flatnonzero(inside)
                for a, b in ((left, left + 1), (left + 1, left)):
                    for row in (word, shape):
                        for beside in (word, shape):
                            for s in range(4):
                                total += np.bincount(row[a] * DIMS + where[beside[b], s], sign[beside[b], s], len(total))
        table = total.reshape(-1, DIMS)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, d].astype(np.int64)) for d in range(DIMS))], ["row", *(f"c{d}" for d in range(DIMS))])

    return run


def pooled(context):
    """Task function: (doc_id, text) to (doc_id, x)."""

    def run(batches):
        table = context.value
        for batch in batches:
            for c in text.chunks(batch.column(1)):
                word, shape, first = tokens(c.data, c.offsets)
                count = np.diff(first)
                some = np.flatnonzero(count)
                x = np.zeros((len(count), table.shape[1] + 2), np.float32)
                if len(some):
                    at = first[some]
                    n = count[some, None]
                    x[some, :-2] = np.add.reduceat(table[word] + table[shape], at) / n
                    who = text.owner(first)
                    different = np.unique(who * (ROWS + SHAPES) + word) // (ROWS + SHAPES)
                    x[some, -2] = np.bincount(different, minlength=len(count))[some] / np.minimum(count[some], ROWS)
                    x[some, -1] = np.log1p(count[some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), text.lists(pa.array(x.reshape(-1)), np.full(len(x), x.shape[1]))], ["doc_id", "x"])

    return run


def scored(model):
    """Task function: (doc_id, x) to (doc_id, score)."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = learn.probabilities(model, x) if isinstance(model, dict) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(np.float64))], ["doc_id", "score"])

    return run


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x): pooled vectors of all rows of docs, by context vectors of all of them."""
    spark = docs.sparkSession
    columns = [f"c{d}" for d in range(DIMS)]
    sums = docs.select("text").mapInArrow(contexts(), "row int, " + ", ".join(f"{c} bigint" for c in columns)).groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    table = np.zeros((ROWS + SHAPES, DIMS), np.float32)
    held = np.stack([sums[c].to_numpy().astype(np.float64) for c in columns], axis=1)
    table[sums["row"].to_numpy()] = held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1)
    context = spark.sparkContext.broadcast(np.concatenate([table, index_vectors() / 2], axis=1))
    return jobs.cut(docs.select("doc_id", "text").mapInArrow(pooled(context), "doc_id bigint, x array<float>"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for each row of docs (doc_id long, text); labels: (doc_id, y) to learn from."""
    x = vectors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    known = labels.where("doc_id is not null and y is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    a, y = learn.sample(x.join(known, "doc_id"), sample)
    model = learn.network(a, y) if len(set(y)) == 2 else float(y.mean()) if len(y) else 0.5
    return x.mapInArrow(scored(model), "doc_id bigint, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    labels = jobs.read(spark, sf_dir, "labels").where(learn.remainder(MODULUS) != HELD_OUT).select("doc_id", F.col("quality").alias("y"))
    out = classify(jobs.read(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (learn.remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
