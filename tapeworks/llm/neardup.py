"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Each of `perms` hash permutations
is evaluated once and gives two signature entries, its least and its greatest
value, so the signature has twice as many entries as there were evaluations.
Entries are grouped in bands of `rows`; documents that agree on a band fall in
one bucket. With the defaults (32 permutations, 16 bands of 4) two documents of
similarity 0.85 miss every bucket with probability (1 - 0.85**4)**16 < 1e-5;
at 0.8, 48 permutations (24 bands) miss with (1 - 0.8**4)**24 < 4e-6.

Rows with equal sets are one class from the start, held by the row of the
smallest doc_id, so copies cost a partial aggregate and no comparison. The
classes in a bucket are compared on their full sets. Buckets with the same
members in several bands are compared once. A bucket that fits a block is one
unit of work. A larger one is dealt into blocks, and each block is compared
with the bucket's `LEADERS` first: classes linked with a same leader need no
comparison among each other, which leaves those that are not linked with the
most common leader, in blocks, to be compared with all blocks of the bucket. So
a bucket of near copies costs a number of comparisons in proportion to its
classes; only a bucket without such a centre costs their square, in units of
bounded size. Units emit only links that join classes they have not joined
yet. Components are those of the classes, named by their least doc_id.

Defined results: each row is a document, also where doc_ids repeat or are null;
null and blank texts have the empty set, are linked with nothing and are their
own component; a component whose documents all have no doc_id has none; extra
columns, whatever their names, are ignored; an empty table gives an empty
result. Sets are sets of 64-bit shingle hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, text

PERMS, ROWS = 32, 4
#: Classes in a block at most, on average, and shingles in it; leaders of a bucket of several blocks.
BLOCK, SHINGLES, LEADERS = 256, 1 << 20, 4
SLICE = 4096


def shingles(w: text.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    left, count = text.room(w.first), np.diff(w.first)
    gram = text.grams(w.hash, n)
    at = np.flatnonzero(left[: len(gram)] >= n)
    value, who = [gram[at]], [text.owner(w.first)[at]]
    for m in range(1, n):
        few = np.flatnonzero(count == m)
        if len(few):
            value.append(text.mix(text.grams(w.hash, m)[w.first[few]] ^ np.uint64(m)))
            who.append(few)
    value, who = np.concatenate(value), np.concatenate(who)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    value, who = value[new], who[new]
    return value, np.searchsorted(who, np.arange(len(count) + 1))


def bands(value: np.ndarray, first: np.ndarray, perms: int, rows: int) -> np.ndarray:
    """Band hashes of each non-empty set, by min-max hashing."""
    some = np.flatnonzero(np.diff(first))
    starts = first[some]
    entries = np.zeros((len(some), 2 * perms), np.uint64)
    if len(some):
        for p in range(perms):
            x = (value ^ text.ODD[p]) * text.ODD[63 - p]
            x ^= x >> np.uint64(29)
            x *= text.ODD[(p * 7 + 3) % 64]
            entries[:, p] = np.minimum.reduceat(x, starts)
            entries[:, perms + p] = np.maximum.reduceat(x, starts)
    # a band mixes least and greatest values of different permutations
    entries = entries.reshape(len(some), 2, perms).transpose(0, 2, 1).reshape(len(some), 2 * perms)
    entries = np.concatenate([entries[:, 0::2], np.roll(entries[:, 1::2], rows // 2, axis=1)], axis=1)
    out = np.zeros((len(some), 2 * perms // rows), np.uint64)
    for b in range(out.shape[1]):
        x = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            x = text.mix(x ^ entries[:, b * rows + r])
        out[:, b] = x
    return out


def sign(n: int, perms: int, rows: int):
    """Task function: (row, doc_id, text) to (row, doc_id, n_shingles, set_key, bands)."""

    def run(batches):
        for batch in batches:
            for c in text.chunks(batch.column(2)):
                w = text.words(c.data, c.offsets, text.SPACE)
                value, first = shingles(w, n)
                size = np.diff(first)
                raw = value.tobytes()
                keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                found = bands(value, first, perms, rows)
                held = text.lists(pa.array(text.signed(found.reshape(-1))), np.where(size > 0, found.shape[1], 0))
                ids = [batch.column(i).slice(c.rows.start, c.rows.stop - c.rows.start) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(size), pa.array(keys, pa.binary()), held], ["row", "doc_id", "n_shingles", "set_key", "bands"])

    return run


def sets(n: int, wanted):
    """Task function: (row, text) to (node, shingles as sorted 64-bit little-endian numbers), at least of wanted rows."""
    only = jobs.with_ids(wanted, True)

    def run(batches):
        for batch in only(batches):
            for c in text.chunks(batch.column(1)):
                value, first = shingles(text.words(c.data, c.offsets, text.SPACE), n)
                raw = value.tobytes()
                held = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), pa.array(held, pa.binary())], ["node", "set"])

    return run


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    if len(a) * len(b) == 1:
        out[0, 0] = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return out
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(va, vb)
    for x in range(0, len(both), SLICE):
        part = both[x : x + SLICE]
        dense = []
        for v, r, n in ((va, ra, len(a)), (vb, rb, len(b))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            m = np.zeros((n, len(part)), np.float32)
            m[r[hit], at[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def linked(ids: tuple[list, list], held: tuple[list, list], percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the two blocks (within the one, if there is one)."""
    if not held[0]:  # a block without classes
        return []
    left, right = held[0], held[1] or held[0]
    a, b = ids[0], ids[1] or ids[0]
    size_a, size_b = (np.array([len(x) for x in y]) for y in (left, right))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    inter = common(left, right).astype(np.int64)
    union = size_a[:, None] + size_b[None, :] - inter
    for i, j in zip(*np.nonzero(100 * inter >= percent * union), strict=True):
        x, y = root(a[i]), root(b[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a[i], b[j]))
    return out


def units(batches):
    """(key, nodes, sets) of each unit in rows (bucket, i, j, side, node, set) that are sorted by it; nodes and sets by side."""
    unit, ids, held = None, ([], []), ([], [])
    for batch in batches:
        names = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        keys = zip(*(names[x].to_pylist() for x in ("bucket", "i", "j")), strict=True)
        for key, side, node, value in zip(keys, names["side"].to_pylist(), names["node"].to_pylist(), names["set"].to_pylist(), strict=True):
            if key != unit:
                if unit is not None:
                    yield unit, ids, held
                unit, ids, held = key, ([], []), ([], [])
            ids[side].append(node)
            held[side].append(np.frombuffer(value, np.uint64))
    if unit is not None:
        yield unit, ids, held


def compare(percent: int):
    """Task function: rows of units to links (a, b)."""

    def run(batches):
        for _, ids, held in units(batches):
            found = linked(ids, held, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def led(percent: int):
    """Task function: rows of units, side 0 leaders and side 1 members, to (bucket, node, leader): the first leader that each member is linked with, or null."""

    def run(batches):
        for (bucket, *_), ids, held in units(batches):
            if not (ids[0] and ids[1]):
                continue
            inter = common(held[1], held[0]).astype(np.int64)
            size = [np.array([len(x) for x in side]) for side in held]
            good = 100 * inter >= percent * (size[1][:, None] + size[0][None, :] - inter)
            leaders = np.array(ids[0], np.int64)[good.argmax(axis=1)]
            n = len(ids[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket)), pa.array(ids[1], pa.int64()), pa.array(leaders, mask=~good.any(axis=1))], ["bucket", "node", "leader"])

    return run


def with_sets(rows: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """rows (bucket, i, j, side, node) with their sets, each unit's together and sorted."""
    wanted = jobs.id_bitmap(rows.select("node").distinct())
    held = docs.select("row", "text").mapInArrow(sets(words, wanted), "node bigint, set binary")
    return rows.join(held, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "node").select("bucket", "i", "j", "side", "node", "set")


def links(docs: DataFrame, member: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(a, b): links between the classes in member (bucket, blocks, node, at) that connect whatever is linked in a bucket."""
    zero = F.lit(0)
    todo = member.where("blocks = 1").select("bucket", zero.alias("i"), zero.alias("j"), zero.alias("side"), "node")
    large, stars = member.where("blocks > 1"), None
    if large.head(1):
        hashed = F.xxhash64("node", "bucket")
        leaders = large.groupBy("bucket", F.pmod(hashed, F.lit(LEADERS)).alias("which")).agg(F.min(F.struct(hashed.alias("h"), "node", "blocks")).alias("m"))
        asked = leaders.select("bucket", F.explode(F.sequence(zero, F.col("m.blocks") - 1)).alias("i"), zero.alias("j"), zero.alias("side"), F.col("m.node").alias("node"))
        met = asked.union(large.select("bucket", F.col("at").alias("i"), zero.alias("j"), F.lit(1).alias("side"), "node"))
        star = jobs.cut(with_sets(met, docs, words).mapInArrow(led(percent), "bucket bigint, node bigint, leader bigint"))
        stars = star.where("leader is not null").select(F.col("leader").alias("a"), F.col("node").alias("b"))
        main = star.where("leader is not null").groupBy("bucket", "leader").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("leader", F.struct("n", "leader")).alias("main"))
        rest = star.join(main, "bucket", "left").where(~F.col("leader").eqNullSafe(F.col("main")) | F.col("main").isNull()).select("bucket", "node")
        rest = jobs.cut(rest.join(large.select("bucket", "node", "blocks"), ["bucket", "node"]))
        share = rest.groupBy("bucket").agg(F.count("*").alias("left"))
        cut = F.ceil(F.col("left") / block).cast("int")
        rest = rest.join(share, "bucket").withColumns({"parts": cut, "part": F.pmod(F.xxhash64("node", F.lit(7)), cut.cast("long")).cast("int")})
        ones = rest.select("bucket", F.col("part").alias("i"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("j"), zero.alias("side"), "node")
        every = large.join(share, "bucket").select("bucket", F.explode(F.sequence(zero, cut - 1)).alias("i"), F.col("at").alias("j"), F.lit(1).alias("side"), "node")
        todo = todo.union(ones).union(every)
    found = with_sets(todo, docs, words).mapInArrow(compare(percent), "a bigint, b bigint")
    return found if stars is None else found.union(stars)


def near_duplicates(docs: DataFrame, words: int, percent: int, perms: int = PERMS, rows: int = ROWS, block: int = BLOCK, numbered: bool = False) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id) for each row of docs (doc_id long, text), which has numbers of its rows in row if numbered.

    component tells components apart where doc_ids repeat or are null; it is
    null for rows without words.
    """
    jobs.small_batches(docs.sparkSession)
    docs = docs if numbered else jobs.with_rows(docs.select("doc_id", "text"))
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = jobs.cut(docs.mapInArrow(sign(words, perms, rows), "row bigint, doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"))
    some = signed.where("set_key is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep")
    inside = some.groupBy("set_key").agg(least, F.first("bands").alias("bands"), F.first("n_shingles").alias("size")).select(F.col("rep.row").alias("node"), "size", F.explode("bands").alias("bucket"))
    counted = inside.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members"), F.min("node").alias("least"), F.max("node").alias("most"), F.sum("size").alias("shingles")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.least("n", F.ceil(F.col("shingles") / SHINGLES))).cast("int")
    buckets = counted.groupBy("n", "members", "least", "most").agg(F.min("bucket").alias("bucket"), F.max("shingles").alias("shingles")).select("bucket", blocks.alias("blocks"))
    member = jobs.cut(inside.join(buckets, "bucket").select("bucket", "blocks", "node", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks").cast("long")).cast("int").alias("at")))
    parts = jobs.components(links(docs, member, words, percent, block))
    classes = some.select("set_key", "doc_id", "row").groupBy("set_key").agg(least).select("set_key", F.col("rep.row").alias("node"), F.col("rep.doc_id").alias("first"))
    joined = classes.join(parts, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "first", F.col("component").isNotNull().alias("several"))
    several = joined.where("several").groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(several, "component", "left").select("set_key", "component", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"))
    return signed.join(named, "set_key", "left").select("row", "doc_id", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.85."""
    out = near_duplicates(jobs.read(spark, sf_dir, "documents"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group under 5-word shingles and a similarity of 0.8.

    That of the smallest doc_id stays, of equal ones one row. Null and blank
    texts are in no group and stay; null doc_ids come after all others; all
    columns stay as they are, whatever their names; an empty table gives an
    empty one.
    """
    name = jobs.unused(docs, "row")
    rows = jobs.with_rows(docs, name)
    found = jobs.cut(near_duplicates(rows.select(F.col(name).alias("row"), "doc_id", "text"), words=5, percent=80, perms=48, numbered=True))
    grouped = found.where("component is not null")
    stays = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = grouped.select("row").join(stays.select("row"), "row", "left_anti")  # by row, as one component may hold a third of all
    return jobs.without(rows, name, gone)
