"""Personal data: regular expressions propose, checksums confirm, context weighs.

Every kind has a pattern that proposes spans, a check that confirms them (Luhn
for cards, mod 97 for bank accounts, ranges and digit counts for the others)
and words that raise the score if they stand shortly before. Everything is
DataFrame functions: no Python runs on executors.

Patterns are written so that each is linear in the text: a run of characters is
entered only where it begins (a look-behind, or the end of the match before,
where the pattern itself could begin inside the run) and is never given back
(possessive quantifiers), which changes none of the leftmost matches.

Positions are code points. They come from the lengths of the matches and of the
pieces between them, added up within groups of `GROUP` matches and then over
groups, and what stands at a position is looked up in parts of `PART` characters,
so that a long text with very many matches costs no square of them.

Every span has a score: its kind's, more if one of the kind's words stands in
the `LOOK` characters before it. The base kinds (email, ip, card, phone) are
all reported, whatever their score; the added ones with a score of at least
`ADDED_SCORE`. A bank account (iban) has that by its check sum alone, while a
social security number (ssn) and a key or password (secret), whose checks are
weak, have it only by the words before them.

Defined results: null texts count as empty and have no spans; matches of one
kind do not overlap, of different kinds may; rows with equal or null doc_id are
separate documents; extra columns, whatever their names, are ignored; an empty
table gives an empty result.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs

LOOK, ADDED_SCORE, GROUP, PART = 40, 0.5, 256, 4096


class Kind(NamedTuple):
    name: str
    pattern: str
    hint: str | None  # the text must hold this for a match
    score: float
    lift: float  # what context adds to the score
    context: str  # words before that raise the score


BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, 0.15, "mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, 0.6, 0.15, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", None, 0.7, 0.15, "card|visa|credit|debit|pay|amex"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, 0.15, "phone|tel|call|mobile|fax|cell"),
]
ADDED = [
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None, 0.7, 0.15, "iban|account|bank|transfer"),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "-", 0.35, 0.3, "ssn|social security|tax id"),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", None, 0.3, 0.4, "token|secret|passw|pwd|api|key|credential"),
]


def proposals(kind: Kind, text: str, m: str) -> tuple[Column, Column]:
    """All matches in the column text, and the pieces of text between them, if there is a match; m: the column of the matches."""
    held = F.lit(True) if kind.hint is None else F.contains(F.col(text), F.lit(kind.hint))
    found = F.when(held, F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return found, F.when(F.size(m) > 0, F.split(F.col(text), kind.pattern, -1))


def group_starts(m: str, p: str) -> Column:
    """Where each group of matches starts: the lengths of all matches m and pieces p before it, or null without a match."""
    size = f"aggregate(sequence(g * {GROUP}, least(size({m}), (g + 1) * {GROUP}) - 1), 0, (s, i) -> s + length({p}[i]) + length({m}[i]))"
    sums = f"transform(sequence(0, (size({m}) - 1) DIV {GROUP}), g -> {size})"
    return F.when(F.size(m) > 0, F.expr(f"aggregate({sums}, struct(0 AS at, cast(array() AS array<int>) AS out), (s, n) -> struct(s.at + n AS at, concat(s.out, array(s.at)) AS out), s -> s.out)"))


def confirmed(kind: Kind, parts: str, m: str, p: str, g: str) -> Column:
    """array<struct<kind, start, end, score>> from the columns of the text's parts, matches, pieces and groups' starts."""
    step = f"struct(s.at + length({p}[i]) + length({m}[i]) AS at, concat(s.out, array(struct(s.at + length({p}[i]) AS start, s.at + length({p}[i]) + length({m}[i]) AS end, {m}[i] AS x))) AS out)"
    within = f"aggregate(sequence(n * {GROUP}, least(size({m}), (n + 1) * {GROUP}) - 1), struct(at AS at, cast(array() AS array<struct<start: int, end: int, x: string>>) AS out), (s, i) -> {step}, s -> s.out)"
    where = F.expr(f"flatten(transform({g}, (at, n) -> {within}))")
    good = F.filter(where, lambda s: checks()[kind.name](s["x"]))

    def told(s):
        first = F.greatest(s["start"] - LOOK, F.lit(0))
        part = F.floor(first / PART).cast("int")
        two = F.concat(F.get(F.col(parts), part), F.coalesce(F.get(F.col(parts), part + 1), F.lit("")))
        near = F.lower(F.substring(two, first - part * PART + 1, F.least(s["start"], F.lit(LOOK))))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?<![a-z0-9_])(?:{kind.context})"), F.lit(kind.lift)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    return F.when(F.size(m) > 0, F.transform(good, told)).otherwise(F.array().cast("array<struct<kind: string, start: int, end: int, score: double>>"))


def checks() -> dict:
    """The checks as functions of a column."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def luhn(x):
        d = F.reverse(digits(x))
        one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda i: 2 * one(i) - F.when(one(i) > 4, 9).otherwise(0)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, one(i)).otherwise(twice(i))) % 10 == 0

    def small(p):
        bare = F.regexp_replace(p, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.when(F.length(bare).between(1, 3), bare).cast("int"), F.lit(0)) <= 255)

    def mod_97(x):
        bare = F.replace(x, F.lit(" "), F.lit(""))
        turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, F.lit(1), F.lit(4)))
        value = lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55))
        base = lambda c: F.when(c == "", F.lit(1)).when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100))
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: (r * base(c) + value(c)) % 97)
        return F.length(bare).between(15, 34) & (rest == 1)

    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x, "[.]"), small),
        "card": lambda x: F.length(digits(x)).between(13, 19) & luhn(x),
        "phone": lambda x: F.length(digits(x)).between(9, 15),
        "iban": mod_97,
        "ssn": lambda x: ~x.rlike("^(?:000|666|9)|-00-|-0000$"),
        "secret": lambda x: (F.length(digits(x)) >= 4) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 4),
    }


def spanned(docs: DataFrame, base: str, spans: str) -> DataFrame:
    """docs with two more columns, of names that it doesn't have: the base kinds' spans, and all spans, each by kind and start."""
    kinds = [*BASE, *ADDED]
    name = {(x, k.name): jobs.unused(docs, f"{x}_{k.name}") for x in "mpgs" for k in kinds}
    text, parts = jobs.unused(docs, "whole_text"), jobs.unused(docs, "text_parts")
    df = docs.withColumn(text, F.coalesce("text", F.lit("")))
    df = df.withColumns({name["m", k.name]: proposals(k, text, name["m", k.name])[0] for k in kinds})
    df = df.withColumns({name["p", k.name]: proposals(k, text, name["m", k.name])[1] for k in kinds})
    df = df.withColumns({name["g", k.name]: group_starts(name["m", k.name], name["p", k.name]) for k in kinds})
    some = F.greatest(*(F.size(name["m", k.name]) for k in kinds)) > 0
    df = df.withColumn(parts, F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    df = df.withColumns({name["s", k.name]: confirmed(k, parts, *(name[x, k.name] for x in "mpg")) for k in kinds})
    added = [F.filter(name["s", k.name], lambda s: s["score"] >= ADDED_SCORE) for k in ADDED]
    first = F.concat(*(F.col(name["s", k.name]) for k in BASE))
    return df.withColumns({base: first, spans: F.concat(first, *added)}).drop(text, parts, *name.values())


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for each row of docs (doc_id, text): arrays of (kind, start, end, score) by kind and start."""
    return spanned(docs.select("doc_id", "text"), "base", "spans").drop("text")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; scores: those of spans, in hundredths, in the same order."""
    found = find(jobs.read(spark, sf_dir, "documents"))
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda name: F.size(F.filter("base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [number(k.name) for k in BASE]
    scores = F.concat_ws(",", F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")))
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), scores.alias("scores"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span gives way to its kind in brackets; overlapping spans to the first one's.

    All rows stay, whatever their doc_id; a null text stays null; n_chars, if
    there is such a column, is told anew; all other columns stay as they are,
    whatever their names; an empty table gives an empty one.
    """
    base, spans, sorted_, reach, parts = (jobs.unused(docs, x) for x in ("base", "spans", "sorted_spans", "reach", "text_parts"))
    found = spanned(docs, base, spans)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.withColumn(sorted_, ordered).withColumn(parts, F.when(F.size(spans) > 0, F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))
    # how far the spans before each group of spans reach; spans that begin within an earlier one go
    groups = f"sequence(0, (size({sorted_}) - 1) DIV {GROUP})"
    most = f"aggregate(slice({sorted_}, n * {GROUP} + 1, {GROUP}), 0, (s, x) -> greatest(s, x.end))"
    found = found.withColumn(reach, F.when(F.size(sorted_) > 0, F.expr(f"aggregate(transform({groups}, n -> {most}), struct(0 AS at, cast(array() AS array<int>) AS out), (s, e) -> struct(greatest(s.at, e) AS at, concat(s.out, array(s.at)) AS out), s -> s.out)")))
    between = f"substring(array_join(slice({parts}, s.at DIV {PART} + 1, greatest(x.start - 1, s.at) DIV {PART} - s.at DIV {PART} + 1), ''), s.at % {PART} + 1, x.start - s.at)"
    step = f"CASE WHEN x.start < s.at THEN struct(greatest(s.at, x.end) AS at, s.out AS out) ELSE struct(x.end AS at, concat(s.out, {between}, '[', upper(x.kind), ']') AS out) END"
    within = f"aggregate(slice({sorted_}, n * {GROUP} + 1, {GROUP}), struct(e AS at, '' AS out), (s, x) -> {step}, s -> s.out)"
    clean = F.concat(F.array_join(F.expr(f"transform({reach}, (e, n) -> {within})"), ""), F.expr(f"substring(text, array_max(transform({sorted_}, x -> x.end)) + 1, length(text))"))
    done = found.withColumn("text", F.when(F.size(sorted_) > 0, clean).otherwise(F.col("text")))
    return done.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
