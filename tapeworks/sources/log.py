"""Write-ahead logs: records of framed messages with a number and a checksum, and what a reader finds in them.

Fixed values: a record is HWAL, the number in 8 bytes, the frame's length with
its prefix in 2, the frame, and the FNV-1a of all that in 8, big-endian.
"""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import fnv1a_of
from ..operators import folds
from . import wire

MAGIC = b"HWAL"
FOUND = "source bigint, segment bigint, at bigint, seq bigint, frame binary, state string"


def append(frames: DataFrame, keep: list[str]) -> DataFrame:
    """keep, seq, record: frames (seq, frame) as log records."""
    kinds = ", ".join(f"{c} {t}" for c, t in frames.select(*keep, "seq").dtypes)

    def records(batches):
        for b in batches:
            bodies = [struct.pack(">4sQHH", MAGIC, seq, len(frame) + 2, len(frame)) + frame for seq, frame in zip(b.column("seq").to_pylist(), b.column("frame").to_pylist(), strict=True)]
            ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
            sums = fnv1a_of(np.frombuffer(b"".join(bodies), np.uint8), np.r_[0, ends[:-1]].astype(np.int64), ends) if bodies else ends
            out = [x + h.to_bytes(8, "big") for x, h in zip(bodies, sums.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*keep, "seq"]), pa.array(out, pa.binary())], [*keep, "seq", "record"])

    return frames.select(*keep, "seq", "frame").mapInArrow(records, f"{kinds}, record binary")


def segments(records: DataFrame, size: int) -> DataFrame:
    """(source, segment, content): records (source, n, record) joined in order of n, size of them to a segment."""
    return records.select("source", F.expr(f"n DIV {size}").alias("segment"), "n", "record").groupBy("source", "segment").agg(F.expr("listagg(record) WITHIN GROUP (ORDER BY n, record)").alias("content"))


def parsed(data: bytes) -> tuple[list[tuple[int, int, int]], tuple | None]:
    """A segment's whole records as (at, seq, end of the frame), and (at, seq, corrupt or truncated) of what ends it early.

    Checksums are checked after the way from record to record is known.
    """
    told, broken, at = [], None, 0
    while at < len(data):
        if len(data) - at < 14:
            broken = (at, None, "truncated")
            break
        magic, seq, size = struct.unpack_from(">4sQH", data, at)
        end = at + 14 + size
        if magic != MAGIC:
            broken = (at, None, "corrupt")
            break
        if len(data) < end + 8:
            broken = (at, seq, "truncated")
            break
        told.append((at, seq, end))
        at = end + 8
    if told:
        starts, ends = (np.array([r[i] for r in told], np.int64) for i in (0, 2))
        raw = np.frombuffer(data, np.uint8)
        kept = raw[ends[:, None] + np.arange(8)].astype(np.uint8).tobytes()
        wrong = np.flatnonzero(fnv1a_of(raw, starts, ends) != np.frombuffer(kept, ">u8"))
        if len(wrong):
            n = int(wrong[0])
            told, broken = told[:n], (*told[n][:2], "corrupt")
    return told, broken


def found(contents: DataFrame) -> DataFrame:
    """(source, segment, at, seq, frame, state) of each segment's records; a broken or cut record ends its segment."""

    def records(source, segment, data):
        told, broken = parsed(data or b"")
        for at, seq, end in told:
            yield (source, segment, at, seq, data[at + 16 : end], "whole")
        if broken:
            yield (source, segment, *broken[:2], None, broken[2])

    return wire.each(contents.select("source", "segment", "content"), records, FOUND)


def read(contents: DataFrame, applied: int = 0) -> DataFrame:
    """found() with status: ok, duplicate, gap, corrupt or truncated, for a reader that has applied numbers up to applied.

    Each segment is parsed by itself, once for which number it leaves applied,
    a few numbers that are carried on segment by segment, and once to be judged.
    A number up to the last applied is a duplicate; with anything applied, a
    number but the next is a gap, which advances nothing. corrupt and truncated
    end the source.
    """

    def told(source, segment, data):
        records, broken = parsed(data or b"")
        yield (source, segment, *links(records), len(records), *(broken or (None, None, None)))

    def carry(key, rows):
        last = applied
        for r in rows:
            yield (*key, r.segment, last, r.whole, r.at, r.seq, r.state)
            if r.state:
                return
            last = next((t for lo, hi, t in zip(r.low, r.high, r.to, strict=True) if lo <= last <= hi), last)

    def judge(source, segment, data, last, whole, broken_at, broken_seq, state):
        at = 0
        for _ in range(whole):
            seq, size = struct.unpack_from(">QH", data, at + 4)
            end = at + 14 + size
            status = "duplicate" if seq <= last else "gap" if last and seq != last + 1 else "ok"
            last = seq if status == "ok" else last
            yield (source, segment, at, seq, data[at + 16 : end], status)
            at = end + 8
        if state:
            yield (source, segment, broken_at, broken_seq, None, state)

    contents = contents.select("source", "segment", "content")
    end = "whole bigint, at bigint, seq bigint, state string"
    ways = wire.each(contents, told, f"source bigint, segment bigint, low array<bigint>, high array<bigint>, to array<bigint>, {end}")
    starts = folds.by_key(ways, ["source"], ["segment"], carry, f"source bigint, segment bigint, last bigint, {end}")
    begun = contents.join(starts.withColumnsRenamed({"source": "s", "segment": "g"}), F.col("source").eqNullSafe(F.col("s")) & F.col("segment").eqNullSafe(F.col("g")))
    return wire.each(begun.select("source", "segment", "content", "last", "whole", "at", "seq", "state"), judge, FOUND.replace("state string", "status string"))


def links(records: list[tuple[int, int, int]]) -> tuple[list, list, list]:
    """(low, high, to): which number a segment leaves applied, where it is another than at its begin.

    From any number of low to high on, its records lead to that of to; from the
    last record back, a record of number s leads from s - 1 to where s leads.
    """
    leads: dict[int, int] = {}
    for _, seq, _ in reversed(records):
        if seq > 0:
            leads[seq - 1] = leads[0] = leads.get(seq, seq)
    low, high, to = [], [], []
    for n, t in sorted(leads.items()):
        if low and high[-1] == n - 1 and to[-1] == t:
            high[-1] = n
        else:
            low.append(n), high.append(n), to.append(t)
    return low, high, to
