"""Text forms: decode traces, hex of captures, book dumps; their checks and comparisons."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import book
from . import wire

#: Fields on the wire that a trace leaves out, by tag.
LEFT_OUT = {"P": {"stock"}, "Q": {"stock"}}


def told(tag: str) -> list[tuple[str, int, int]]:
    """(name, offset, bytes) of the fields that a trace tells of a message."""
    return [f for f in [*wire.HEADER, *wire.FIELDS[tag][1]] if f[0] not in LEFT_OUT.get(tag, ())]


def field_specs(spark: SparkSession) -> DataFrame:
    """(tag, place, field, bytes): the fields of each traced message."""
    return spark.createDataFrame([(t, i, n, s) for t in wire.FIELDS for i, (n, _, s) in enumerate(told(t))], "tag string, place int, field string, bytes int")


def lines(frames: DataFrame, keep: list[str], index: Column) -> DataFrame:
    """keep, index, line: the trace of frames (frame, declared, complete), one line each."""
    d = wire.decode(frames).withColumn("index", index)
    letters = {"ok": "D", "truncated_body": "T", "unknown_type": "S", "malformed": "M", "bad_length": "L"}
    code = F.try_element_at(F.create_map(*(F.lit(x) for kv in letters.items() for x in kv)), F.col("status"))
    seen = F.when(F.length("frame") > 0, F.lower(F.hex(F.substring("frame", 1, 1))))
    # each field is worked out once for all tags that have it, in order of place: a chain with every tag's own would be too long a method for the JVM to compile
    spots: dict = {}
    for t in wire.FIELDS:
        for _, o, s in told(t):
            spots.setdefault((o, s), []).append(t)
    part = lambda o, s: F.hex(F.substring("frame", o + 1, s))
    fields = F.lower(F.concat_ws(" ", *(part(*at) if len(tags) == len(wire.FIELDS) else F.when(wire.among(tags), part(*at)) for at, tags in sorted(spots.items()))))
    d = d.withColumn("code", code)
    kind = F.coalesce(F.when(F.col("complete"), seen), F.lit("--"))
    parts = F.when(F.col("code") == "D", fields)
    return d.select(*keep, "index", F.concat_ws(" ", F.col("index"), "code", kind, F.lpad(F.col("declared").cast("string"), 4, "0"), parts).alias("line"))


def write(lines: DataFrame, path: str, piece: int = 1 << 16) -> None:
    """Trace lines (..., index, line) as text files, in order of index within each; piece numbers of a trace stay together, so that files grow in number and not in size."""
    keys = [F.col(c) for c in lines.columns if c not in ("index", "line")]
    near = [F.expr(f"index DIV {piece}")] if "index" in lines.columns else []
    lines.repartition(*keys, *near).sortWithinPartitions(*lines.columns).select("line").write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path).withColumnRenamed("value", "line"))


def parsed(text: DataFrame) -> DataFrame:
    """Traces read back: index, code, tag, length, fields and ok from (line); comments and blanks are skipped.

    ok: a D line has its tag's fields, each of its width, and no other line has any.
    """
    p = F.split(F.trim("line"), r"\s+")
    rows = text.where(~F.trim("line").rlike("^(#.*)?$")).select("*", p.alias("p"))
    tag = F.when(F.get("p", F.lit(2)) != "--", F.decode(F.unhex(F.get("p", F.lit(2))), "ISO-8859-1"))
    shapes = F.create_map(*(F.lit(x) for t in wire.FIELDS for x in (t, "^" + " ".join(f"[0-9a-f]{{{2 * s}}}" for _, _, s in told(t)) + "$")))
    shape = F.try_element_at(shapes, tag)
    fields = F.slice("p", 5, F.greatest(F.size("p") - 4, F.lit(0)))
    joined = F.array_join(fields, " ")
    ok = F.when(F.get("p", F.lit(1)) == "D", F.coalesce(F.regexp_like(joined, shape), F.lit(False))).otherwise(F.coalesce(F.get("p", F.lit(1)).isin("S", "L", "M", "T"), F.lit(False)) & (joined == ""))
    return rows.select(*text.columns, F.get("p", F.lit(0)).try_cast("bigint").alias("index"), F.get("p", F.lit(1)).alias("code"), tag.alias("tag"), F.get("p", F.lit(3)).try_cast("int").alias("length"), fields.alias("fields"), ok.alias("ok")).drop("line")


def compare(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_one, line_other, word: the lines (keys, line) that differ, and the first word that does, from 0."""
    both = one.withColumnRenamed("line", "line_one").join(other.withColumnRenamed("line", "line_other"), keys, "full_outer")
    a, b = F.split(F.coalesce("line_one", F.lit("")), " "), F.split(F.coalesce("line_other", F.lit("")), " ")
    places = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return both.where(~F.col("line_one").eqNullSafe(F.col("line_other"))).select(*keys, "line_one", "line_other", (F.array_position(places, True) - 1).alias("word"))


def hex_lines(contents: DataFrame, width: int = 64) -> DataFrame:
    """(source, n, line): each content in lower-case hex, width bytes to a line."""
    places = F.when(F.length("content") > 0, F.sequence(F.lit(0), F.expr(f"(length(content) - 1) DIV {width}").cast("int")))
    rows = contents.select("source", "content", F.explode(places).alias("n"))
    return rows.select("source", "n", F.lower(F.hex(F.substring(F.col("content"), F.col("n") * width + 1, F.lit(width)))).alias("line"))


def word(value: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(value.cast("long"))), digits, "0")


def dump(orders: DataFrame) -> DataFrame:
    """(symbol, n, line): each symbol's book as text, a line for each level, followed by its orders; bids first."""
    side = F.when(F.col("side") == "B", "B").otherwise("A")
    w = Window.partitionBy("symbol").orderBy("side", book.better(), "position")
    queue = book.queue_positions(orders).join(orders.select("order_id", "size", "state"), "order_id")
    order_text = F.concat_ws(" ", F.lit("O"), side, word(F.col("order_id")), word(F.col("px_raw")), word(F.col("size")), F.col("state").cast("string"), F.col("position").cast("string"))
    level_text = F.concat_ws(" ", F.lit("L"), side, word(F.col("px_raw")), F.col("order_count").cast("string"), word(F.col("agg_size")))
    parts = queue.select("symbol", "side", "px_raw", "position", order_text.alias("text")).unionByName(book.levels(orders).select("symbol", "side", "px_raw", F.lit(-1).alias("position"), level_text.alias("text")))
    n = (F.row_number().over(w) - 1).cast("long")
    return parts.select("symbol", n.alias("n"), F.concat_ws(" ", n.cast("string"), "text").alias("line"))


def write_dump(orders: DataFrame, path: str) -> None:
    """Each symbol's dump, and its checksum as a comment, as text in a folder of its own."""
    sums = book.checksums(orders).select("symbol", F.lit(None).cast("long").alias("n"), F.concat(F.lit("# checksum "), "checksum").alias("line"))
    lines = dump(orders).unionByName(sums)
    lines.repartition("symbol").sortWithinPartitions("symbol", F.asc_nulls_last("n")).select("symbol", "line").write.partitionBy("symbol").text(path)


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dumps read back: levels (symbol, n, side, px_raw, order_count, agg_size), orders (symbol, n, side, order_id, px_raw, size, state, position) and checksums (symbol, checksum).

    Blank lines and other comments are skipped; numbers that don't parse are null.
    """
    text = spark.read.schema("value string, symbol string").text(path).select("symbol", F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line"))
    p = F.split("line", " ")
    number = lambda i: F.conv(F.get("p", F.lit(i)), 16, 10).try_cast("bigint")
    plain = lambda i, kind: F.get("p", F.lit(i)).try_cast(kind)
    side = F.when(F.get("p", F.lit(2)) == "B", "B").otherwise("S").alias("side")
    rows = text.where("line <> '' AND NOT startswith(line, '#')").withColumn("p", p)
    levels = rows.where("get(p, 1) = 'L'").select("symbol", plain(0, "bigint").alias("n"), side, number(3).alias("px_raw"), plain(4, "bigint").alias("order_count"), number(5).alias("agg_size"))
    orders = rows.where("get(p, 1) = 'O'").select("symbol", plain(0, "bigint").alias("n"), side, number(3).alias("order_id"), number(4).alias("px_raw"), number(5).alias("size"), plain(6, "int").alias("state"), plain(7, "bigint").alias("position"))
    sums = text.where("startswith(line, '# checksum ')").select("symbol", F.substring_index("line", " ", -1).alias("checksum"))
    return levels, orders, sums


def inspected(frames: DataFrame) -> DataFrame:
    """(tag, n, last_length, expected, verdict): messages by tag, against the length that the tag should have."""
    lengths = {t: n for t, (n, _) in wire.FIELDS.items()}
    tag = F.decode(F.substring("frame", 1, 1), "ISO-8859-1")
    counted = frames.select(tag.alias("tag"), "seq", F.length("frame").alias("length")).groupBy("tag").agg(F.count("*").alias("n"), F.max_by("length", F.struct("seq", "length")).alias("last_length"))
    want = F.try_element_at(F.create_map(*(F.lit(x) for kv in lengths.items() for x in kv)), F.col("tag"))
    verdict = F.when(want.isNull(), "not_decoded").when(F.col("last_length") == want, "ok").otherwise("bad_length")
    return counted.select("tag", "n", "last_length", want.alias("expected"), verdict.alias("verdict"))
