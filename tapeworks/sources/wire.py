"""Binary order messages: encoding, packets, the walk over frames, and decoding.

Frames are encoded and decoded by column expressions, and one grouping makes
packets of them. Only the walk over a packet's blocks is a Python function over
Arrow batches, one row for each frame.
"""

import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import shared

#: Fixed values: (name, offset, bytes) of each message's fields after the tag, and its length.
HEADER = [("locate", 1, 2), ("tracking", 3, 2), ("ts_ns", 5, 6)]
ADD = [("order_id", 11, 8), ("side", 19, 1), ("qty", 20, 4), ("stock", 24, 8), ("px_raw", 32, 4)]
FIELDS = {
    "A": (36, ADD),
    "E": (31, [("order_id", 11, 8), ("qty", 19, 4), ("match", 23, 8)]),
    "C": (36, [("order_id", 11, 8), ("qty", 19, 4), ("match", 23, 8), ("printable", 31, 1), ("px_raw", 32, 4)]),
    "X": (23, [("order_id", 11, 8), ("qty", 19, 4)]),
    "D": (19, [("order_id", 11, 8)]),
    "U": (35, [("order_id", 11, 8), ("new_id", 19, 8), ("qty", 27, 4), ("px_raw", 31, 4)]),
    "B": (19, [("match", 11, 8)]),
    "P": (44, [*ADD, ("match", 36, 8)]),
    "Q": (40, [("qty", 11, 8), ("stock", 19, 8), ("px_raw", 27, 4), ("match", 31, 8), ("cross_type", 39, 1)]),
    "S": (12, [("event_code", 11, 1)]),
}
TEXT = {"side", "stock", "printable", "cross_type", "event_code"}
WIDE = {"order_id", "new_id", "match", "qty"}
END_OF_SESSION = 0xFFFF


def number(body: Column, at: int, size: int) -> Column:
    """A big-endian number of up to 8 bytes, exact."""
    return F.conv(F.hex(F.substring(body, at + 1, size)), 16, 10).cast("decimal(20,0)")


def big_endian(value: Column, size: int, kind: str = "bigint") -> Column:
    """The hex of a number in size bytes; null for one that is negative or too wide. kind: its type, decimal(20,0) for unsigned 64 bits."""
    if kind.startswith("decimal"):
        digits, most = F.conv(value.cast("string"), 10, 16), F.lit(str(256**size)).cast("decimal(20,0)")
        return F.when((value >= 0) & (value < most), F.lpad(digits, 2 * size, "0"))
    value = value.cast("long")
    return F.when((value >= 0) & (value < 256**size) if size < 8 else value >= 0, F.lpad(F.hex(value), 2 * size, "0"))


def encode(messages: DataFrame) -> DataFrame:
    """Adds frame and fits: the body of each message, by its tag, with missing fields as 0 (texts as blanks, printable as Y).

    fits is false, and frame null, where a number is negative or too wide for
    its field, a text is longer than its field or has characters outside
    ISO-8859-1, or the tag has no layout. Numbers may come as bigint or
    decimal(20,0).
    """
    kinds = dict(messages.dtypes)
    columns = set(kinds)

    def field(name, size):
        name = "symbol" if name == "stock" and "stock" not in columns else name
        if name not in columns:
            return F.lit("59" if name == "printable" else "20" * size if name in (*TEXT, "symbol") else "00" * size)
        if name in (*TEXT, "symbol"):
            text = F.coalesce(F.col(name).cast("string"), F.lit("Y" if name == "printable" else ""))
            return F.when((F.length(text) <= size) & ~text.rlike("[^\\x00-\\xFF]"), F.hex(F.encode(F.rpad(text, size, " "), "ISO-8859-1")))
        return big_endian(F.coalesce(F.col(name), F.lit(0).cast(kinds[name])), size, kinds[name])

    # each field is worked out once for all tags: a chain with every tag's own would be too long a method for the JVM to compile
    parts = {(n, s): field(n, s) for _, fields in FIELDS.values() for n, _, s in [*HEADER, *fields]}
    at = {k: f"_part{i}" for i, k in enumerate(parts)}
    body = F.lit(None).cast("string")
    for tag, (_, fields) in FIELDS.items():
        body = F.when(F.col("tag") == tag, F.concat(F.lit(f"{ord(tag):02X}"), *(F.col(at[n, s]) for n, _, s in [*HEADER, *fields]))).otherwise(body)
    messages = messages.withColumns({at[k]: c for k, c in parts.items()})
    return messages.withColumn("frame", F.unhex(body)).withColumn("fits", F.col("frame").isNotNull()).drop(*at.values())


def prefixed(frame: Column) -> Column:
    """A frame with its length in two bytes before it."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(frame).cast("long")), 4, "0")), frame)


def packets(frames: DataFrame, blocks: int = 64, name: Column | None = None) -> DataFrame:
    """(session, packet_no, content): frames of (session, seq, frame), blocks to a packet with seq from 1 on, or by a column packet_no.

    A packet tells its first frame's seq, and the session as S and its number
    unless name tells otherwise. Rows without a frame fail the query: a packet
    must not count what it doesn't hold.
    """
    no = F.col("packet_no") if "packet_no" in frames.columns else F.expr(f"(seq - 1) DIV {blocks}")
    frame = F.coalesce("frame", F.raise_error(F.concat(F.lit("no frame for message "), F.col("seq").cast("string"))).cast("binary"))
    grouped = frames.select("session", no.alias("packet_no"), "seq", prefixed(frame).alias("block")).groupBy("session", "packet_no").agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.expr("listagg(block) WITHIN GROUP (ORDER BY seq)").alias("blocks"))
    told = F.concat(F.lit("S"), F.col("session").cast("string")) if name is None else name
    head = F.concat(F.hex(F.rpad(told, 10, " ")), big_endian(F.col("first"), 8), big_endian(F.col("n"), 2))
    return grouped.select("session", "packet_no", F.concat(F.unhex(head), "blocks").alias("content"))


def each(contents: DataFrame, frames: Callable[..., Iterator[tuple]], schema: str, most: int = 8192, most_bytes: int = 1 << 24) -> DataFrame:
    """Rows that frames(*content) yields for each row of contents; they leave in batches of bounded length, however many a content or a batch of contents holds."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    sized = [i for i, f in enumerate(kinds) if pa.types.is_binary(f.type)]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches):
        out, held = [], 0
        for b in batches:
            for n in range(b.num_rows):
                for row in frames(*(c[n].as_py() for c in b.columns)):
                    out.append(row)
                    held += sum(len(row[i] or b"") for i in sized)
                    if len(out) == most or held >= most_bytes:
                        yield batch(out)
                        out, held = [], 0
        if out:
            yield batch(out)

    return contents.mapInArrow(run, schema)


FRAME = "source bigint, packet_no bigint, session string, seq decimal(20,0), idx int, declared int, complete boolean, frame binary"


def walk(contents: DataFrame, emit_partial: bool = False) -> DataFrame:
    """Frames of (source, content): packets one after the other in each content.

    Heartbeats hold no frames; the end-of-session packet ends the walk, and so
    does a cut header. A cut frame is left out, or told with complete = false,
    and with no declared length where even that is cut.
    """

    def frames(source, data):
        at, packet = 0, 0
        while data is not None and at + 20 <= len(data):
            session, seq, count = struct.unpack_from(">10sQH", data, at)
            at += 20
            if count == END_OF_SESSION:
                return
            name = session.decode("latin-1").rstrip(" ")
            for i in range(count):
                if at + 2 > len(data):
                    if emit_partial:
                        yield (source, packet, name, seq + i, i, None, False, data[at:])
                    at = len(data)
                    break
                (size,) = struct.unpack_from(">H", data, at)
                body = data[at + 2 : at + 2 + size]
                at += 2 + size
                if len(body) == size or emit_partial:
                    yield (source, packet, name, seq + i, i, size, len(body) == size, body)
            packet += 1

    return each(contents.select("source", "content"), frames, FRAME)


def among(tags) -> Column:
    """Whether tag, a single character, is one of tags; a list for isin would make longer code."""
    return F.contains(F.lit("".join(tags)), F.col("tag"))


def decode(frames: DataFrame) -> DataFrame:
    """Adds tag, status and every field: ok, truncated, truncated_body, bad_length, unknown_type or malformed, the first that holds.

    truncated: fewer than the two bytes of a length were there (declared is
    null); truncated_body: the body was cut.
    """
    body = F.col("frame")
    tag = F.when(F.length(body) > 0, F.decode(F.substring(body, 1, 1), "ISO-8859-1"))
    known = F.create_map(*(F.lit(x) for t, (n, _) in FIELDS.items() for x in (t, n)))
    df = frames.withColumns({"tag": tag}).withColumn("want", F.try_element_at(known, F.col("tag")))
    fields: dict = {n: F.when(F.length(body) >= 11, number(body, o, s).cast("long")) for n, o, s in HEADER}
    for name in dict.fromkeys(n for _, f in FIELDS.values() for n, _, _ in f):
        value, places = F.lit(None), {}
        for t, (_, spec) in FIELDS.items():
            for n, o, s in spec:
                if n == name:
                    places.setdefault((o, s), []).append(t)
        for (o, s), tags in places.items():
            read = F.rtrim(F.decode(F.substring(body, o + 1, s), "ISO-8859-1")) if name in TEXT else number(body, o, s)
            value = F.when(among(tags) & (F.length(body) == F.col("want")), read).otherwise(value)
        fields[name] = value.cast("string") if name in TEXT else value if name in WIDE else value.cast("long")
    complete = F.col("complete") if "complete" in frames.columns else F.lit(True)
    df = df.withColumns(fields)
    bad_id = among("AECXDU") & (F.col("order_id") == 0)
    cut = F.col("declared").isNull() if "declared" in frames.columns else F.lit(False)
    status = (
        F.when(cut, "truncated")
        .when(~complete, "truncated_body")
        .when(F.length(body) < 1, "bad_length")
        .when(F.col("want").isNull(), "unknown_type")
        .when(F.length(body) != F.col("want"), "bad_length")
        .when(bad_id | ((F.col("tag") == "A") & ~F.col("side").isin("B", "S")), "malformed")
        .otherwise("ok")
    )
    return df.withColumn("status", status).drop("want")


def write_captures(contents: DataFrame, folder: str) -> int:
    """Each row of (source, content) as a file of its own, <source>.bin; the number of files.

    Tasks write under a name of their own first and then move it, so a task
    that runs again leaves the same files.
    """

    def put(batches):
        where, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = f"{root}/_{source}-{uuid.uuid4().hex}"
                with where.open_output_stream(mine) as out:
                    out.write(data.as_py())
                where.move(mine, f"{root}/{source}.bin")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["source"])

    if folder.startswith("file:") or "://" not in folder:
        fs.LocalFileSystem().create_dir(folder.removeprefix("file://").removeprefix("file:"))
    return contents.select(F.col("source").cast("long").alias("source"), "content").mapInArrow(put, "source bigint").count()


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, content): capture files (*.bin) whole, a row for each; source is a number of the path's hash.

    A file is one row, of at most 2 GB; longer captures should be cut between packets. Empty files give none.
    """
    shared.small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select("path", F.xxhash64("path").alias("source"), "content")


def inspect(frames: DataFrame) -> DataFrame:
    """(tag, n, shortest, longest, bad): messages by type, their lengths, and how many don't decode."""
    return decode(frames).groupBy("tag").agg(F.count("*").alias("n"), F.min(F.length("frame")).cast("long").alias("shortest"), F.max(F.length("frame")).cast("long").alias("longest"), F.count_if(F.col("status") != "ok").alias("bad"))


def same_symbol(one: Column, other: Column) -> Column:
    """Whether two symbols are the same, whatever their case and the blanks after them."""
    return F.upper(F.rtrim(one)) == F.upper(F.rtrim(other))


def repacked(frames: DataFrame, session: str, skip_to: str | None = None, most_bytes: int | None = None, blocks: int = 64) -> DataFrame:
    """(source, packet_no, content): raw frames (source, idx, declared, complete, frame) as packets of a session with a name of 10 characters.

    Packets are numbered by their first frame's idx. A source ends at a cut or
    empty frame. With skip_to it begins at its first message of that tag; with
    most_bytes it ends at the first frame that would not fit after all packets
    before its own.
    """
    by_idx = Window.partitionBy("source").orderBy("idx")
    so_far = by_idx.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("declared").cast("long") + 2
    rows = frames.withColumn("whole", F.min(F.coalesce(F.col("complete") & (F.col("declared") > 0), F.lit(False))).over(so_far)).where("whole")
    if skip_to:
        hit = F.when(F.substring("frame", 1, 1) == F.lit(skip_to.encode()), F.col("idx"))
        rows = rows.withColumn("begin", F.min(hit).over(Window.partitionBy("source"))).where("idx >= begin")
    rows = rows.withColumn("packet_no", F.expr(f"(row_number() OVER (PARTITION BY source ORDER BY idx) - 1) DIV {blocks}"))
    if most_bytes is not None:
        rows = rows.withColumn("past", F.sum(size).over(so_far) - size)
        rows = rows.withColumn("fits", F.min("past").over(Window.partitionBy("source", "packet_no")) + 20 * F.col("packet_no") + size <= most_bytes)
        rows = rows.withColumn("fits", F.min("fits").over(so_far)).where("fits")
    made = packets(rows.select(F.col("source").alias("session"), "packet_no", F.col("idx").alias("seq"), "frame"), blocks, F.lit(session))
    return made.withColumnRenamed("session", "source")


def packet_list(frames: DataFrame) -> DataFrame:
    """(source, packet_no, session, first, n): the packets that walked frames come from."""
    return frames.groupBy("source", "packet_no").agg(F.min("session").alias("session"), F.min("seq").cast("long").alias("first"), F.count("*").alias("n"))


def walk_raw(contents: DataFrame) -> DataFrame:
    """(source, idx, declared, complete, frame) of (source, content): frames without packets around them; a last one may be cut, without declared if its length is."""

    def frames(source, data):
        at, i = 0, 0
        while data is not None and at + 2 <= len(data):
            (size,) = struct.unpack_from(">H", data, at)
            body = data[at + 2 : at + 2 + size]
            yield (source, i, size, len(body) == size, body)
            at, i = at + 2 + size, i + 1
        if data is not None and at < len(data):
            yield (source, i, None, False, data[at:])

    return each(contents.select("source", "content"), frames, "source bigint, idx bigint, declared int, complete boolean, frame binary")


def turned(digits: Column, size: int = 8) -> Column:
    """Hex digits of size bytes with the bytes in the other order."""
    return F.concat(*(F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)))


def receive_time(payload: Column) -> Column:
    """Nanoseconds of a 16-byte little-endian (seconds, nanoseconds); null where cut or with nanoseconds out of range."""
    part = [F.conv(turned(F.hex(F.substring(payload, i, 8))), 16, 10).cast("decimal(20,0)") for i in (1, 9)]
    return F.when((F.length(payload) >= 16) & (part[1] < 1_000_000_000), (part[0] * 1_000_000_000 + part[1]).cast("decimal(38,0)"))
