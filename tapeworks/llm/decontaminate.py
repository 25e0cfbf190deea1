"""Benchmark decontamination by winnowing.

Every window of `window` consecutive item words is looked for in the documents.
Of the word k-grams in each window the least hash is its fingerprint
(k + w - 1 = window, w grams to a window), so equal windows have equal
fingerprints at the same place and no shared window can be missed. Fingerprints
of documents and benchmark are joined; each hit carries the word hashes around
it and is extended left and right, word by word, and counts if the run is at
least a window long. An item with fewer words than a window is one window of
its own length.

Defined results: null and empty texts, and texts without words, have no words
and are never hit; items that are null or without words hit nothing; equal
item_ids count once; rows with equal or null doc_id are separate documents;
extra columns, whatever their names, are ignored; empty tables give empty
results.

Scale: documents are read once and shuffled only as counts and hits. A bitmap
of benchmark fingerprints (128 MB at most, however large the benchmark) spares
documents the join where nothing can match. A short item is one hit for each
document that has it, with all its places. The join takes the benchmark's
fingerprints to the documents if there are at most `CARRIED` of them; beyond
that both sides are shuffled by fingerprint, and hits are dealt over `SALTS`
keys, so that a passage that a third of all documents hold is no single task's.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, text

WINDOW, GRAM = 10, 5
CARRIED, SALTS = 100_000, 16
#: at: where the words stand; before: words before a fingerprint, nearest first; after: words after it.
HIT = "array<struct<fp: bigint, at: array<int>, words: int, before: array<bigint>, after: array<bigint>>>"


def around(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, k: int, reach: int) -> tuple[pa.Array, pa.Array]:
    """Hashes of up to reach words before and after each k-gram, nearest first, within lo and hi."""
    steps = np.arange(reach)
    out = []
    for where, good in ((at[:, None] - 1 - steps, at[:, None] - 1 - steps >= lo[:, None]), (at[:, None] + k + steps, at[:, None] + k + steps < hi[:, None])):
        out.append(text.lists(pa.array(text.signed(hashes[np.clip(where, 0, max(len(hashes) - 1, 0))][good])), good.sum(axis=1)))
    return out[0], out[1]


def fingerprints(w: text.Words, window: int, k: int) -> np.ndarray:
    """Positions of the windows' fingerprints, ascending."""
    at = text.minimisers(text.grams(w.hash, k), window - k + 1, text.room(w.first), k)
    return np.unique(at[at >= 0])


def short_fp(hashes: np.ndarray, n: int) -> np.ndarray:
    return text.mix(text.grams(hashes, n) + np.uint64(n * 0x9E3779B9))


def item_rows(window: int, k: int):
    """Task function: (id, text) to a row for each fingerprint of an item."""

    def rows(batches):
        for batch in batches:
            for c in text.chunks(batch.column(1)):
                w = text.words(c.data, c.offsets, text.PUNCT)
                ids = batch.column(0).cast(pa.string()).slice(c.rows.start, c.rows.stop - c.rows.start)
                who, count = text.owner(w.first), np.diff(w.first)
                at = fingerprints(w, window, k)
                before, after = around(w.hash, w.first[who[at]], w.first[who[at] + 1], at, k, window - k)
                yield pa.RecordBatch.from_arrays([pa.array(text.signed(text.grams(w.hash, k)[at])), ids.take(pa.array(who[at])), pa.array(np.full(len(at), k, np.int32)), before, after], ["fp", "item_id", "words", "before", "after"])
                for n in range(1, window):
                    at = w.first[:-1][count == n]
                    none = pa.array([[]] * len(at), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(text.signed(short_fp(w.hash, n)[at])), ids.take(pa.array(who[at])), pa.array(np.full(len(at), n, np.int32)), none, none], ["fp", "item_id", "words", "before", "after"])

    return rows


def doc_rows(window: int, k: int, short: list[int], known):
    """Task function: (row, doc_id, text) to row, doc_id, number of words and possible hits."""

    def rows(batches):
        for batch in batches:
            for c in text.chunks(batch.column(2)):
                w = text.words(c.data, c.offsets, text.PUNCT)
                who, left, parts = text.owner(w.first), text.room(w.first), []
                for n in [0, *short]:
                    if n:
                        fp = short_fp(w.hash, n)
                        at = np.flatnonzero(left[: len(fp)] >= n)
                    else:
                        fp, at = text.grams(w.hash, k), fingerprints(w, window, k)
                    at = at[text.may_hold(known.value, fp[at])]
                    parts.append((at, fp[at], np.full(len(at), n)))
                at, fp, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((at, fp, n, who[at]))
                at, fp, n = at[order], fp[order], n[order]
                owner = who[at]
                new = np.ones(len(at), bool)
                new[1:] = (n[1:] == 0) | (n[1:] != n[:-1]) | (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
                one = np.flatnonzero(new)
                places = text.lists(pa.array((at - w.first[owner]).astype(np.int32)), np.diff(np.r_[one, len(at)]))
                at, fp, n, owner = at[one], fp[one], n[one], owner[one]
                lo, hi = np.where(n == 0, w.first[owner], at), np.where(n == 0, w.first[owner + 1], at)  # a short item is whole
                before, after = around(w.hash, lo, hi, at, k, window - k)
                hits = pa.StructArray.from_arrays([pa.array(text.signed(fp)), places, pa.array(np.where(n == 0, k, n).astype(np.int32)), before, after], ["fp", "at", "words", "before", "after"])
                count = np.bincount(owner, minlength=len(w.first) - 1)
                kept = [batch.column(i).slice(c.rows.start, c.rows.stop - c.rows.start) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(w.first)), text.lists(hits, count)], ["row", "doc_id", "n_words", "hits"])

    return rows


def run_length(a: str, b: str):
    """How many leading words two arrays share."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(equal, F.lit(False))
    return F.when(miss == 0, F.size(equal)).otherwise(miss - 1).cast("int")


def covered(spans):
    """Positions in any of (start, end) spans."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))
    add = lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("sum"), F.greatest(s["end"], x["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda s: s["sum"])


def by_row(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM, carried: int = CARRIED) -> DataFrame:
    """A row for each row of docs (row, doc_id, text): row, doc_id, n_words, spans, items; see find()."""
    index = jobs.cut(items.select("item_id", "text").where("item_id is not null").mapInArrow(item_rows(window, k), "fp bigint, item_id string, words int, before array<bigint>, after array<bigint>").distinct())
    short = sorted(r["words"] for r in index.where("size(before) + size(after) = 0").select("words").distinct().collect())  # one to window - 1
    known = jobs.bitmap(index, "fp")
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("row", "doc_id", "text").mapInArrow(doc_rows(window, k, short, known), f"row bigint, doc_id {kind}, n_words bigint, hits {HIT}")
    found = found.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    # a row without hits gets a key of its own, or all of them would meet in one partition
    found = found.withColumn("fp", F.coalesce("fp", F.xxhash64("row")))
    told = index.toDF("fp", "item_id", "item_words", "item_before", "item_after")
    if index.count() <= carried:
        hits = found.join(F.broadcast(told), "fp", "left")
    else:
        spread = told.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = found.withColumn("salt", F.pmod("row", F.lit(SALTS))).join(spread, ["fp", "salt"], "left")
    left, right = run_length("before", "item_before"), run_length("after", "item_after")
    hits = hits.withColumns({"short": F.size("item_before") + F.size("item_after") == 0, "left": left, "right": right})
    good = F.col("item_id").isNotNull() & (F.col("words") == F.col("item_words")) & (F.col("short") | (F.col("left") + F.col("right") + k >= window))
    whole = F.transform("at", lambda a: F.struct(a.alias("start"), (a + F.col("words")).alias("end")))
    grown = F.transform("at", lambda a: F.struct((a - F.col("left")).alias("start"), (a + k + F.col("right")).alias("end")))
    spans = F.collect_set(F.when(good, F.when(F.col("short"), whole).otherwise(grown)))
    return (
        hits.groupBy("row", "doc_id")
        .agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(spans))).alias("spans"), F.array_sort(F.collect_set(F.when(good, F.col("item_id")))).alias("items"))
        .select("row", "doc_id", "n_words", "spans", "items")
    )


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = GRAM, carried: int = CARRIED) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, spans, items.

    spans: array of (start, end) word positions hit, overlapping ones apart;
    items: the item_ids, as strings in order, with windows in the text.
    """
    return by_row(jobs.with_rows(docs.select("doc_id", "text")), items, window, k, carried).drop("row")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark."""
    hits = find(jobs.read(spark, sf_dir, "documents"), jobs.read(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("spans")).cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a word in any benchmark window.

    Rows are judged each by its own text, whatever their doc_id, null ones and
    repeated ones too; null and empty texts stay; all columns stay as they are,
    whatever their names; an empty table gives an empty one.
    """
    name = jobs.unused(docs, "row")
    rows = jobs.with_rows(docs, name)
    found = by_row(rows.select(F.col(name).alias("row"), "doc_id", "text"), jobs.read(spark, sf_dir, "benchmark"))
    return jobs.without(rows, name, found.where(F.size("spans") > 0))
