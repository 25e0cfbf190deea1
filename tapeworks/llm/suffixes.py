"""Suffix-array dedup with sparse suffix arrays.

Suffixes are retained only where the content selects them: at the minimisers,
positions of the least k-gram among each w consecutive ones. Any span of at
least `shared` words that two documents share has a minimiser in common, at the
same place in its first k + w - 1 words. Retained suffixes are sorted by the
words that follow; a suffix and its neighbours from other documents, on either
side, share the longest beginnings. Matches of neighbours are extended right
and left, word by word, and count if they reach `shared` words. Overlapping
matches of one document are merged to spans, so spans of any length come out
whole though a suffix carries only `shared` words to its right and w - 1 to its
left.

Defined results: one row for each span of each row: doc_id, its first word, its
number of words, and the smallest neighbouring document that shares a part of
it. Null, blank and short texts give no rows, and neither do rows with a null
doc_id; a span that repeats only within one doc_id gives none, and rows with
equal doc_id have spans of their own; extra columns, whatever their names, are
ignored; an empty table gives an empty result.

Scale: a span of `shared` words has its first minimiser in its first w places,
so at least shared - w + 1 words follow there. A bitmap of at most 128 MB, folded
on the executors, tells which such beginnings stand in more than one document;
only suffixes that have one are sorted. The sort is a range partitioning on the following words and then the
doc_id, so a passage that a third of all documents share spreads over many
tasks.

A neighbour in that order need not share the words to the left, and the nearest
one may lie in another partition. So a window of `shared` words that some
neighbour may have, judged by the words after the suffix, and no compared one
has, is looked up by its 64-bit hash among the windows around all suffixes. The
other document of such a window is the smallest that has it; for that document
itself, the largest.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, substrings, text

SHARED, GRAM, SPAN = 50, 8, 24
ROW = "doc_id bigint, at int, after binary, before binary, row bigint"


def retained(k: int, w: int, shared: int, known):
    """Task function: (row, doc_id, text) to suffixes: doc_id, at, the words after and before (nearest first), 4 bytes each, and row."""

    def run(batches):
        for batch in batches:
            for c in text.chunks(batch.column(2)):
                words = text.words(c.data, c.offsets, text.SPACE, lower=False)
                gram = text.grams(words.hash, k)
                at = text.minimisers(gram, w, text.room(words.first), k)
                at = np.unique(at[at >= 0])
                at = at[text.room(words.first)[at] >= shared - w + 1]
                at = at[text.may_hold(known.value, text.grams(words.hash, shared - w + 1)[at])]
                who = text.owner(words.first)[at]
                code = (words.hash >> np.uint64(32)).astype(">u4").tobytes()
                back = (words.hash[::-1] >> np.uint64(32)).astype(">u4").tobytes()
                n = len(words.hash)
                lo, hi = words.first[who].tolist(), words.first[who + 1].tolist()
                here = at.tolist()
                after = [code[4 * p : 4 * min(p + shared, b)] for p, b in zip(here, hi, strict=True)]
                before = [back[4 * (n - p) : 4 * (n - max(a, p - w + 1))] for p, a in zip(here, lo, strict=True)]
                keys, ids = (batch.column(i).slice(c.rows.start, c.rows.stop - c.rows.start) for i in range(2))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(who)), pa.array((at - words.first[who]).astype(np.int32)), pa.array(after, pa.binary()), pa.array(before, pa.binary()), keys.take(pa.array(who))], ["doc_id", "at", "after", "before", "row"])

    return run


def shared_words(a: bytes, b: bytes) -> int:
    """How many leading 4-byte words two strings share."""
    if a == b:
        return len(a) // 4
    x, y = (np.frombuffer(s, np.uint32, min(len(a), len(b)) // 4) for s in (a, b))
    miss = np.flatnonzero(x != y)
    return int(miss[0]) if len(miss) else len(x)


def neighbours(rows: list, shared: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int]]]:
    """(doc, first word, number of words, other doc, row) of the sorted suffixes' matches with the nearest ones of other documents; open windows.

    An open window, (index of the row, words before the suffix), is one that
    another document may have, because a neighbour shares the words after the
    suffix, but that no compared neighbour has. At the ends of rows, where the
    nearest suffix of another document is not seen, all windows are open.
    """
    out = []
    seen: list = [[] for _ in rows]  # words shared after and before with the nearest rows of other documents on either side
    last = other = None  # the last row, and the last one from another document than that
    for i, row in enumerate(rows):
        near = last if last is not None and rows[last][0] != row[0] else other
        if near is not None:
            beside = rows[near]
            right = shared_words(row[2], beside[2])
            left = shared_words(row[3], beside[3])
            seen[i].append((right, left))
            if near == i - 1:
                seen[near].append((right, left))
            if left + right >= shared:
                out += [(row[0], row[1] - left, left + right, beside[0], row[4]), (beside[0], beside[1] - left, left + right, row[0], beside[4])]
        if last is None or rows[last][0] != row[0]:
            other = last
        last = i
    # the other way round, for suffixes whose nearest one of another document comes after a row of their own
    follow = third = None
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        if follow is not None and rows[follow][0] == row[0] and third is not None:
            beside = rows[third]
            right = shared_words(row[2], beside[2])
            left = shared_words(row[3], beside[3])
            seen[i].append((right, left))
            if left + right >= shared:
                out += [(row[0], row[1] - left, left + right, beside[0], row[4])]
        if follow is None or rows[follow][0] != row[0]:
            third = follow
        follow = i
    unsettled = []
    for i, (row, pairs) in enumerate(zip(rows, seen, strict=True)):
        least = max(shared - (max(r for r, _ in pairs) if len(pairs) == 2 else shared), shared - len(row[2]) // 4, 0)
        for right, left in pairs:
            if shared - right <= least <= left:
                least = left + 1
        unsettled += [(i, j) for j in range(least, len(row[3]) // 4 + 1) if not any(shared - right <= j <= left for right, left in pairs)]
    return out, unsettled


def window_hashes(after: list[bytes], before: list[bytes], shared: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, the hash of the shared words from j words before it on, for j below w; and whether there are so many."""
    words = np.zeros((len(after), w - 1 + shared), np.uint32)
    n_after, n_before = (np.fromiter((len(x) // 4 for x in side), np.int64, len(side)) for side in (after, before))
    right = np.frombuffer(b"".join(x.ljust(4 * shared, b"\0") for x in after), np.uint32).reshape(len(after), shared)
    left = np.frombuffer(b"".join(x.ljust(4 * (w - 1), b"\0") for x in before), np.uint32).reshape(len(after), w - 1)
    words[:, w - 1 :], words[:, : w - 1] = right, left[:, ::-1]
    up, down = text.powers(w + shared)
    total = np.zeros((len(after), w + shared), np.uint64)
    np.cumsum(text.mix(words.astype(np.uint64)) * up[: w - 1 + shared], axis=1, out=total[:, 1:])
    j = np.arange(w)
    begin = w - 1 - j
    hashes = text.mix((total[:, begin + shared] - total[:, begin]) * down[begin])
    return hashes, (j <= n_before[:, None]) & (shared - j <= n_after[:, None])


def windows_among(shared: int, w: int, asked):
    """Task function: suffixes to (win, doc_id): their windows whose hash may be asked for."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, whole = window_hashes(batch.column(2).to_pylist(), batch.column(3).to_pylist(), shared, w)
            row, j = np.nonzero(whole)
            win = hashes[row, j]
            some = text.may_hold(asked.value, win)
            yield pa.RecordBatch.from_arrays([pa.array(text.signed(win[some])), batch.column(0).take(pa.array(row[some]))], ["win", "doc_id"])

    return run


def sweep(shared: int, w: int, limit: int = 200_000):
    """Task function: sorted suffixes to matches and to open windows, which have a hash."""

    def run(batches):
        rows: list = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            if len(rows) > limit:
                yield from told(rows)
                rows = []
        if rows:
            yield from told(rows)

    def told(rows):
        found, unsettled = neighbours(rows, shared)
        cols = [[x[i] for x in found] for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.nulls(len(found), pa.int64()), pa.array(cols[4], pa.int64())], ["doc_id", "at", "length", "other", "win", "row"])
        for lo in range(0, len(unsettled), 8192):
            some = unsettled[lo : lo + 8192]
            hashes, _ = window_hashes([rows[i][2] for i, _ in some], [rows[i][3] for i, _ in some], shared, w)
            win = hashes[np.arange(len(some)), [j for _, j in some]]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in some], pa.int64()), pa.array([rows[i][1] - j for i, j in some], pa.int32()), pa.array([shared] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(text.signed(win)), pa.array([rows[i][4] for i, _ in some], pa.int64())], ["doc_id", "at", "length", "other", "win", "row"])

    return run


def merge(batches):
    """Task function: (doc_id, spans) to (doc_id, start, length, match_doc_id): overlapping and touching spans as one, with the least other document."""
    for batch in batches:
        out: list[list[int]] = []
        for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine: list[list[int]] = []
            for s in spans:
                if mine and s["at"] <= mine[-1][2]:
                    mine[-1][2], mine[-1][3] = max(mine[-1][2], s["end"]), min(mine[-1][3], s["other"])
                else:
                    mine.append([doc, s["at"], s["end"], s["other"]])
            out += mine
        yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in out], pa.int64()) for f in (lambda x: x[0], lambda x: x[1], lambda x: x[2] - x[1], lambda x: x[3])], ["doc_id", "start", "length", "match_doc_id"])


def repeats(docs: DataFrame, shared: int = SHARED, k: int = GRAM, w: int = SPAN) -> DataFrame:
    """(doc_id, start, length, match_doc_id): spans of words that other documents share."""
    docs = jobs.with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc_id", "text").where("doc_id is not null and text is not null")
    known = substrings.shared_anchors(docs, k + w - 1, k, shared - w + 1)
    suffixes = jobs.cut(docs.mapInArrow(retained(k, w, shared, known), ROW))
    order = ["after", "doc_id", "at", "row"]
    found = jobs.cut(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(sweep(shared, w), "doc_id bigint, at int, length int, other bigint, win bigint, row bigint"))
    unsettled = found.where("win is not null")
    asked = jobs.bitmap(unsettled, "win")
    held = suffixes.mapInArrow(windows_among(shared, w, asked), "win bigint, doc_id bigint").groupBy("win").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    settled = unsettled.select("win", "row", "doc_id", "at", "length").distinct().join(held, "win").withColumn("other", F.when(F.col("doc_id") == F.col("least"), F.col("most")).otherwise(F.col("least")))
    columns = ["row", "doc_id", "at", "length", "other"]
    match = found.where("win is null").select(columns).union(settled.select(columns)).withColumn("end", F.col("at") + F.col("length"))
    spans = match.groupBy("row", "doc_id", "at", "end").agg(F.min("other").alias("other")).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "end", "other"))).alias("spans"))
    return spans.select("doc_id", "spans").mapInArrow(merge, "doc_id bigint, start bigint, length bigint, match_doc_id bigint")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of at least 50 words that documents share with others."""
    return repeats(jobs.read(spark, sf_dir, "documents"))
