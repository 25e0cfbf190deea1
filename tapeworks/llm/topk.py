"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates come to a task in blocks of bounded size. In a block each dimension
has a list of its vectors sorted by that component. A query reads all lists
from the end that its own component favours, some entries deeper each time;
every vector met is scored exactly. No unmet vector can score more than the sum
of the query's components times the list values reached; once the k-th best
score, those of earlier blocks included, exceeds that bound the block is done.
The best k of all blocks are the answer.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part; an inner product is taken only between vectors of equal
length; rows with a query's own vec_id are no candidates of it; rows that repeat
another vec_id are candidates each; of query rows that repeat a vec_id the
least vector counts; ties go to the smaller vec_id; extra columns are ignored;
empty tables give empty results.

Scale: candidates are dealt into slices and queries into groups, both by the
bytes there are, and each pair of them is one key of a single shuffle: no join,
and no key that all rows share. A task holds one group of queries and k scores
for each, and goes through its candidates as a stream, in blocks of `BLOCK`
bytes. A candidate is sent once for each `GROUP` bytes of queries.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jobs

#: Bytes of candidates in a block and in a slice, and of queries in a group, at 8 a component.
BLOCK, SLICE, GROUP = 4 << 20, 64 << 20, 16 << 20
K, SCALE, EVERY = 5, 256, 50


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def threshold_search(vectors: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, top: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the query's best k among a block's vectors and top, those known before; order[d] sorts the block by component d."""
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    unmet = ids != own
    top_id, top_score = top or (ids[:0], vectors[:0, 0])
    lo, hi = 0, max(16, n // 64)
    while True:
        hi = min(hi, n)
        met = np.zeros(n, bool)
        met[order[up, n - hi : n - lo]] = True
        met[order[down, lo:hi]] = True
        new = np.flatnonzero(met & unmet) if len(up) + len(down) else np.flatnonzero(unmet)
        unmet[new] = False
        score = np.r_[top_score, vectors[new] @ query]
        who = np.r_[top_id, ids[new]]
        keep = best(score, who, k)
        top_id, top_score = who[keep], score[keep]
        bound = vectors[order[up, n - hi], up] @ query[up] + vectors[order[down, hi - 1], down] @ query[down]
        if hi == n or not unmet.any() or len(top_id) == k and top_score[-1] > bound:
            return top_id, top_score
        lo, hi = hi, 4 * hi


class Group:
    """Queries of one length and their best k so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.top: list = [None] * len(ids)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        largest = max(int(np.abs(x).max(initial=0)) for x in (vectors, self.vectors))
        kind = np.float64 if largest * largest * vectors.shape[1] < 2**53 else np.int64  # doubles hold such sums exactly
        vectors, queries = vectors.astype(kind), self.vectors.astype(kind)
        order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        for i, (own, q) in enumerate(zip(self.ids.tolist(), queries, strict=True)):
            found, score = threshold_search(vectors, order, ids, q, own, self.k, self.top[i])
            self.top[i] = (found, score.astype(np.int64))

    def told(self) -> pa.RecordBatch:
        some = [(i, t) for i, t in zip(self.ids.tolist(), self.top, strict=True) if t is not None]
        n = [len(t[0]) for _, t in some]
        whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _ in some], np.int64), n)), whole([t[0] for _, t in some]), whole([t[1] for _, t in some])], ["query_id", "vec_id", "score"])


def search(k: int, block: int):
    """Task function: rows (slice, part, dim, side, vec_id, vector) sorted by the first four to (query_id, vec_id, score).

    Side 0 are a key's queries, side 1 the candidates that they meet.
    """

    def run(batches):
        key, group, ids, parts, held = None, None, [], [], 0

        def flush():
            nonlocal ids, parts, held
            if ids and group is not None:
                group.meet(np.concatenate(ids), np.concatenate(parts))
            ids, parts, held = [], [], 0

        asked_ids: list = []
        asked: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edge = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                now, side, dim = tuple(keys[a, :3].tolist()), int(keys[a, 3]), int(keys[a, 2])
                if now != key:
                    flush()
                    if group is not None:
                        yield group.told()
                    key, group, asked_ids, asked = now, None, [], []
                own = batch.column(4).slice(a, b - a).to_numpy()
                vectors = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(-1, dim)
                if side == 0:
                    asked_ids.append(own)
                    asked.append(vectors)
                    continue
                if group is None and asked:
                    group = Group(np.concatenate(asked_ids), np.concatenate(asked), k)
                if group is None:
                    continue
                for at in range(0, b - a, max(1, block // (8 * dim))):
                    some = slice(at, min(b - a, at + max(1, block // (8 * dim))))
                    ids.append(own[some])
                    parts.append(vectors[some])
                    held += vectors[some].nbytes
                    if held >= block:
                        flush()
        flush()
        if group is not None:
            yield group.told()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, slice_bytes: int = SLICE, group_bytes: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors and queries of (vec_id long, vector array<bigint>)."""
    spark = vectors.sparkSession
    vectors = jobs.with_rows(vectors.select("vec_id", "vector")).select("row", "vec_id", "vector", F.size("vector").alias("dim"))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).select("vec_id", "vector", F.size("vector").alias("dim"))
    many = lambda df, size: 1 + (df.agg(F.sum(F.col("dim").cast("long"))).first()[0] or 0) * 8 // size
    slices, groups = max(many(vectors, slice_bytes), spark.sparkContext.defaultParallelism), many(queries, group_bytes)
    dealt = lambda n, *what: F.pmod(F.xxhash64(*what), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = vectors.select(dealt(slices, "row").alias("slice"), every(groups).alias("part"), "dim", F.lit(1).alias("side"), "vec_id", "vector")
    asked = queries.select(every(slices).alias("slice"), dealt(groups, "vec_id").alias("part"), "dim", F.lit(0).alias("side"), "vec_id", "vector")
    units = asked.union(candidates).repartition("slice", "part").sortWithinPartitions("slice", "part", "dim", "side")
    found = units.mapInArrow(search(k, block), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of the vectors without null or non-finite components."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where("vec_id is not null and size(embedding) > 0").where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")).alias("vector"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each one whose vec_id is divisible by 50."""
    vectors = integers(jobs.read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(f"vec_id % {EVERY} = 0"))


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
