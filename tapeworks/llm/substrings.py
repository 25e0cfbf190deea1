"""Substring dedup by an exact join of window hashes.

A window is `window` consecutive words of one document. Windows whose winnowing
anchor (the least k-gram hash in the window) may stand in several documents are
grouped by their hash, and joined back to the smallest doc_id that holds them.
This takes the place of relative Lempel-Ziv parsing against indexed reference
blocks: no block is indexed and no document parsed against its words. Only what
the join found is named as factors: a factor is a maximal run of positions
whose windows have the same source, a smaller doc_id. Words covered by factors
are removed. Windows are judged on the input, not on what is left.

Defined results: null, empty and blank texts have no words and keep the empty
string; documents with fewer words than a window lose nothing; each row is a
document of its own, and rows with equal doc_id never take words from each
other; a null doc_id is neither smaller nor greater than any, so such rows
lose nothing and nothing is lost to them; extra columns, whatever their names,
are ignored; an empty table gives an empty result.

Scale: a first pass counts, for each anchor, whether more than one document
holds it, as a bitmap of at most 128 MB (anchors that share a bit only add
lookups). Only windows with such anchors are shuffled, once for each document,
and the least and the greatest doc_id are aggregated before the shuffle, so a
passage that a third of all documents share is a few partial rows. A second
bitmap holds the windows that stand in two doc_ids; only those are shuffled
again, to learn their sources, and windows of more than `COMMON` rows are dealt
over `SALTS` keys there. Texts of documents without hits stay where they are
read. Windows are told apart by 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, text

WINDOW, GRAM = 13, 7
COMMON, SALTS = 100_000, 64
#: Bytes of text that a task works on at once.
CHUNK = 1 << 18


def anchors(window: int, k: int, length: int):
    """Task function: (text) to (anchor, docs): docs is 1, or 2 if several documents of the chunk hold it.

    An anchor is the hash of the length words from a minimiser on.
    """

    def rows(batches):
        for batch in batches:
            for c in text.chunks(batch.column(0), CHUNK):
                w = text.words(c.data, c.offsets, text.SPACE, lower=False)
                gram = text.grams(w.hash, k)
                at = text.minimisers(gram, window - k + 1, text.room(w.first), k)
                at = np.unique(at[at >= 0])
                at = at[text.room(w.first)[at] >= length]
                gram = text.grams(w.hash, length)
                pairs = np.stack([gram[at], text.owner(w.first)[at].astype(np.uint64)], axis=1)
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                new = np.r_[True, pairs[1:, 0] != pairs[:-1, 0]] if len(pairs) else np.zeros(0, bool)
                group = np.flatnonzero(new)
                last = np.r_[group[1:], len(pairs)] - 1
                docs = 1 + (pairs[last, 1] != pairs[group, 1]) if len(pairs) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(text.signed(np.ascontiguousarray(pairs[group, 0]))), pa.array(docs.astype(np.int32))], ["anchor", "docs"])

    return rows


def windows(window: int, k: int, known, shared=None, common=None):
    """Task function: (row, doc_id, text) to (win, salt, row, doc_id, at): each text's different windows whose anchor is in the bitmap known, or which are in shared themselves.

    salt spreads the rows of a window in the bitmap common.
    """

    def rows(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for c in text.chunks(batch.column(2), CHUNK):
                w = text.words(c.data, c.offsets, text.SPACE, lower=False)
                if shared is None:
                    gram = text.grams(w.hash, k)
                    anchor = text.minimisers(gram, window - k + 1, text.room(w.first), k)
                    at = np.flatnonzero(anchor >= 0)
                    at = at[text.may_hold(known.value, gram[anchor[at]])]
                    win = text.grams(w.hash, window)[at]
                else:
                    win = text.grams(w.hash, window)
                    at = np.flatnonzero((text.room(w.first)[: len(win)] >= window) & text.may_hold(shared.value, win))
                    win = win[at]
                who = text.owner(w.first)[at]
                order = np.lexsort((at, win, who))
                at, win, who = at[order], win[order], who[order]
                new = np.ones(len(at), bool)
                new[1:] = (win[1:] != win[:-1]) | (who[1:] != who[:-1])
                at, win, who = at[new], win[new], who[new]
                row = keys[c.rows][who]
                salt = np.where(text.may_hold(common.value, win), row % SALTS, 0) if common else np.zeros(len(win), np.int64)
                ids = batch.column(1).slice(c.rows.start, c.rows.stop - c.rows.start)
                yield pa.RecordBatch.from_arrays([pa.array(text.signed(win)), pa.array(salt.astype(np.int32)), pa.array(row), ids.take(pa.array(who)), pa.array((at - w.first[who]).astype(np.int32))], ["win", "salt", "row", "doc_id", "at"])

    return rows


def spread(common):
    """Task function: (win, source) to (win, source, salt), once for each salt that windows() gives the window."""

    def rows(batches):
        for batch in batches:
            times = np.where(text.may_hold(common.value, batch.column(0).to_numpy().view(np.uint64)), SALTS, 1)
            which = pa.array(np.repeat(np.arange(batch.num_rows), times))
            salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(salt.astype(np.int32))], ["win", "source", "salt"])

    return rows


def factorise(at: np.ndarray, source: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of hit window starts: first word, number of words, source document."""
    order = np.argsort(at, kind="stable")
    at, source = at[order], source[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (source[1:] != source[:-1])])
    last = np.r_[begin[1:], len(at)] - 1
    return at[begin], at[last] - at[begin] + window, source[begin]


def everywhere(win: np.ndarray, at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the windows at the given ones, and their sources."""
    good = at < len(win)
    keys, source = win[at[good]], source[good]
    order = np.argsort(keys)
    keys, source = keys[order], source[order]
    if not len(keys):
        return at[:0], source
    where = np.minimum(np.searchsorted(keys, win), len(keys) - 1)
    hit = np.flatnonzero(keys[where] == win)
    return hit, source[where[hit]]


def parse(window: int, keep_text: bool):
    """Task function: (doc_id, text, at, source) to the document's words less those in factors."""

    def rows(batches):
        for batch in batches:
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "start": [], "length": [], "source": []}
            at_list, source_list = batch.column(2), batch.column(3)
            for c in text.chunks(batch.column(1), CHUNK):
                w = text.words(c.data, c.offsets, text.SPACE, lower=False)
                raw = c.data.tobytes()
                for i in range(c.rows.stop - c.rows.start):
                    lo, hi = w.first[i], w.first[i + 1]
                    keep = np.ones(hi - lo, bool)
                    hits = at_list[c.rows.start + i]
                    start = length = source = np.zeros(0, np.int64)
                    if hits.is_valid and len(hits.values):
                        start, length, source = factorise(*everywhere(text.grams(w.hash[lo:hi], window), hits.values.to_numpy(), source_list[c.rows.start + i].values.to_numpy()), window)
                        edge = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(edge, start, 1)
                        np.add.at(edge, start + length, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                    kept = b" ".join([raw[a:b] for a, b in zip(w.start[lo:hi][keep].tolist(), w.end[lo:hi][keep].tolist(), strict=True)])
                    out["n_words"].append(hi - lo)
                    out["n_removed"].append(int((~keep).sum()))
                    out["kept"].append(kept.decode() if keep_text else hashlib.sha256(kept).hexdigest())
                    for name, x in (("start", start), ("length", length), ("source", source)):
                        out[name].append(x.tolist())
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()), *(pa.array(out[x], whole) for x in ("start", "length", "source"))], ["doc_id", "n_words", "n_removed", "kept", "start", "length", "source"])

    return rows


def shared_anchors(docs: DataFrame, window: int, k: int, length: int):
    """A bitmap of the anchors that more than one row of docs (text) holds."""
    found = docs.select("text").mapInArrow(anchors(window, k, length), "anchor bigint, docs int")
    return jobs.bitmap(found.groupBy("anchor").agg(F.sum("docs").alias("docs")).where("docs > 1"), "anchor")


def dedup(docs: DataFrame, window: int = WINDOW, k: int = GRAM, keep_text: bool = True, common: int = COMMON) -> DataFrame:
    """A row for each row of docs (doc_id long, text): doc_id, n_words, n_removed, kept and factors.

    kept: the words left, joined by one space, or with keep_text=False their
    SHA-256 in hex. start, length, source: arrays of the factors' first words,
    numbers of words and source documents.
    """
    docs = jobs.with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("row", "doc_id", "text")
    known, kinds = shared_anchors(docs, window, k, k), "win bigint, salt int, row bigint, doc_id bigint, at int"
    named = docs.where("doc_id is not null")
    seen = named.mapInArrow(windows(window, k, known), kinds).groupBy("win").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("most"), F.count("*").alias("rows"))
    first = jobs.cut(seen.where("source < most").select("win", "source", "rows"))
    shared, often = jobs.bitmap(first, "win"), jobs.bitmap(first.where(F.col("rows") > common), "win", least=16)
    win = named.mapInArrow(windows(window, k, known, shared, often), kinds)
    sources = first.select("win", "source").mapInArrow(spread(often), "win bigint, source bigint, salt int")
    hits = win.join(sources, ["win", "salt"]).where("doc_id > source").groupBy("row").agg(F.collect_set(F.struct("at", "source")).alias("hit"))
    hits = jobs.cut(hits.select("row", F.col("hit.at").alias("at"), F.col("hit.source").alias("source")))
    hit = jobs.id_bitmap(hits.select("row"))
    plain, schema = "row bigint, doc_id bigint, text string", "doc_id bigint, n_words bigint, n_removed bigint, kept string, start array<bigint>, length array<bigint>, source array<bigint>"
    some = docs.mapInArrow(jobs.with_ids(hit, True), plain).join(hits, "row", "left")
    none = docs.mapInArrow(jobs.with_ids(hit, False), plain).withColumns({"at": F.lit(None).cast("array<int>"), "source": F.lit(None).cast("array<bigint>")})
    return some.select("doc_id", "text", "at", "source").unionByName(none.select("doc_id", "text", "at", "source")).mapInArrow(parse(window, keep_text), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents, each word judged by windows of 13 words."""
    out = dedup(jobs.read(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
