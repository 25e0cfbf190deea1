"""Toxicity by noisy-channel deobfuscation.

A token in which digits or symbols stand for letters, letters repeat, or
letters are spaced out is read as a lattice: each character may be itself, a
letter it imitates, or nothing (a separator or one repetition too many), at
channel costs. Viterbi decoding under a character trigram model of all
documents picks the letters that were meant, in tokens of any length; where
there are separators, also the likeliest way to break the token into words. Two
equal letters in a row count as spelling, and so do spaced runs of fewer than
four characters. The text's words, restored ones
included, are then scored: each word's log odds of standing in a toxic
document, gathered over all labelled documents that may be learned from, and a
logistic model over the document's strongest words.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2. Word
counts take all of these; the logistic model is fitted on at most `SAMPLE` of
them, whose own label is taken out of the counts first. All words that speak for
toxicity count; tasks hold the `LEXICON` most frequent ones, the others are
joined to the texts by their hashes. doc_id only chooses rows and is no
input of a score, nor are lang and source.

Defined results: null and empty texts get the score of a text without known
words; rows with equal or null doc_id are scored each; labels that are null or
of no document are ignored; without labels of both kinds every score is the
share of label 1, or 0 without any; extra columns, whatever their names, are
ignored; an empty table gives an empty result.

Scale: the character model is a table of fixed size. Texts are only shuffled if
they may have a label. Word counts are aggregated in each task first.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs, learn, text

SAMPLE, LEXICON, LEAST = 20_000, 100_000, 2
HELD_OUT, MODULUS, CUT = 2, 4, 0.3
#: Letters that digits and symbols stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
IMITATE, SKIP, DROP, COLLAPSE, REMEMBERED = -1.0, -0.7, -6.0, -0.5, 40
ALPHABET = 28  # 0 a word's edge, 1 to 26 letters, 27 any other
FOLD = text.LOWER.copy()
CODE = np.zeros(256, np.int64)
CODE[0x61:0x7B] = np.arange(1, 27)
CODE[0x80:] = 27
LEET_BYTE = np.zeros(256, bool)
LEET_BYTE[[ord(c) for c in LEET]] = True
WIDE = re.compile(r"\s{2,}")
SIGN_BYTE = LEET_BYTE | ~text.NOT_LETTER


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of U+00C0 to U+00DE, whose second byte is 32 below that of the small letter."""
    out = FOLD[data]
    at = np.flatnonzero(data == 0xC3) + 1
    at = at[at < len(data)]
    at = at[(data[at] < 0x9F) & (data[at] != 0x97)]
    out[at] += 32
    return out


def trigrams():
    """Task function: (text) to (code, n): counts of letter trigrams in words with their edges."""

    def run(batches):
        total = np.zeros(ALPHABET**3, np.int64)
        for batch in batches:
            for c in text.chunks(batch.column(0)):
                code = np.r_[0, 0, CODE[fold(c.data)], 0]
                old, mid, new = code[:-2].copy(), code[1:-1], code[2:]
                old[mid == 0] = 0
                real = (mid > 0) | (new > 0)
                total += np.bincount((old[real] * ALPHABET + mid[real]) * ALPHABET + new[real], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    return run


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third letter | first two), from all documents."""
    sums = docs.select("text").mapInArrow(trigrams(), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(ALPHABET**3)
    count[sums["code"].to_numpy()] = sums["n"].to_numpy()
    count = count.reshape(ALPHABET, ALPHABET, ALPHABET)
    two = count.sum(axis=0) + 0.1
    back = two / two.sum(axis=1, keepdims=True)
    return np.log((count + 2 * back[None]) / (count.sum(axis=2, keepdims=True) + 2))


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def readings(c: str, before: str) -> list[tuple[str, float]]:
    """What a character may stand for, and at which cost; an empty string is nothing."""
    if c in LEET:
        return [*((x, IMITATE) for x in LEET[c]), ("", DROP if c.isdigit() else SKIP)]
    if not c.isalpha():
        return [("", SKIP)]
    return [(c, 0.0), ("", COLLAPSE)] if c == before else [(c, 0.0)]


def decode(token: str, model: np.ndarray, parts: bool = False, meant: bool = False) -> str:
    """The likeliest word behind a token of any length, by Viterbi over the last two letters.

    With parts, a word may also end at each character that is no letter or digit; the words come with blanks between them.
    With meant, each digit or symbol that can stand for a letter does.
    """
    token = token.lower()
    cost_of = model.item
    states: dict = {(0, 0): (0.0, None)}  # to the score and the letters, as a chain from the last one back
    before = ""
    for c in token:
        after: dict = {}
        options = readings(c, before)[: -1 if meant and c in LEET else None]
        ends = parts and not c.isalnum()
        for (a, b), (score, out) in states.items():
            for x, cost in options:
                if x:
                    key = (b, letter(x))
                    value = score + cost + cost_of(a, b, key[1])
                else:
                    key, value = (a, b), score + cost
                if key not in after or value > after[key][0]:
                    after[key] = (value, (x, out) if x else out)
            if ends and b:
                value = score + SKIP + cost_of(a, b, 0)
                if (0, 0) not in after or value > after[0, 0][0]:
                    after[0, 0] = (value, (" ", out))
        states, before = after, c
    _, out = max(((score + (cost_of(a, b, 0) if b or not parts else 0.0), out) for (a, b), (score, out) in states.items()), key=lambda x: x[0])
    letters = []
    while out:
        letters.append(out[0])
        out = out[1]
    return "".join(reversed(letters)).strip()


def words_behind(token: str, model: np.ndarray) -> list[bytes]:
    """The likeliest words behind a token: as one word, as several where it has separators, and with its substitutes, but a last '!', as letters."""
    found = {decode(token, model)}
    if any(not c.isalnum() for c in token):
        found.update(decode(token, model, True).split(" "))
        found.update(decode(part, model) for part in WIDE.split(token))
    if any(c in LEET for c in token.rstrip("!")):
        found.add(decode(token.rstrip("!"), model, False, True))
    return [w.encode() for w in sorted(found) if w]


def suspects(data: np.ndarray, folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of tokens that may be disguised words."""
    tok = text.words(data, offsets, text.SPACE, lower=False)
    # runs of what may be letters: tokens of several of them, with a substitute beside another character, or with three equal letters in a row
    run = text.words(folded, offsets, ~SIGN_BYTE, lower=False)
    if not len(run.start):
        return run.start, run.end
    before = lambda x: np.r_[0, np.cumsum(x)]
    substitutes, same = before(LEET_BYTE[data]), np.zeros(len(data), bool)
    same[2:] = (folded[2:] == folded[1:-1]) & (folded[2:] == folded[:-2]) & (data[2:] < 0x80) & ~text.NOT_LETTER[data[2:]]
    repeats = before(same)
    size = run.end - run.start
    flag = (size > 1) & (substitutes[run.end] > substitutes[run.start])
    flag |= (size > 2) & (repeats[run.end] > repeats[np.minimum(run.start + 2, run.end)])
    within = np.searchsorted(tok.start, run.start, "right") - 1
    flag[1:] |= within[1:] == within[:-1]
    which = np.unique(within[flag])
    # four or more single characters that may be letters, with nothing but separators between them
    single = np.diff(before((data & 0xC0) != 0x80)[np.stack([run.start, run.end])], axis=0)[0] == 1
    next_to = np.zeros(len(single), bool)
    next_to[1:] = single[1:] & single[:-1]
    next_to[run.first[:-1][run.first[:-1] < len(single)]] = False
    edge = np.flatnonzero(np.diff(np.r_[False, next_to, False].astype(np.int8)))
    first, last = edge[0::2] - 1, edge[1::2] - 1
    varied = np.array([len(set(folded[run.start[a : b + 1]].tolist())) > 1 for a, b in zip(first.tolist(), last.tolist(), strict=True)], bool)
    long = (last - first >= 3) & varied if len(first) else np.zeros(0, bool)
    return np.r_[tok.start[which], run.start[first[long]]].astype(np.int64), np.r_[tok.end[which], run.end[last[long]]].astype(np.int64)


def doc_words(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, memory: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different word hashes with their texts' indexes, restored words included, and each text's number of words."""
    folded = fold(data)
    plain = text.words(folded, offsets, text.NOT_LETTER, lower=False)
    value, who = [plain.hash], [text.owner(plain.first)]
    start, end = suspects(data, folded, offsets)
    raw = data.tobytes()
    words, owners = [], []
    for a, b, d in zip(start.tolist(), end.tolist(), (np.searchsorted(offsets, start, "right") - 1).tolist(), strict=True):
        token = raw[a:b].decode(errors="ignore")
        behind = memory.get(token)
        if behind is None:
            behind = words_behind(token, model)
            if len(token) <= REMEMBERED:
                if len(memory) > 50_000:
                    memory.clear()
                memory[token] = behind
        words += behind
        owners += [d] * len(behind)
    if words:
        ends = np.cumsum([len(w) for w in words])
        value.append(text.hash_spans(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends))
        who.append(np.array(owners))
    value, who = np.concatenate(value), np.concatenate(who)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[new], who[new], np.diff(plain.first)


def word_counts(model):
    """Task function: (y, text) to (word, toxic, clean): in how many texts of each label a word stands."""

    def run(batches):
        memory: dict = {}
        for batch in batches:
            y = batch.column(0).to_numpy()
            for c in text.chunks(batch.column(1), 2 << 20):
                value, who, _ = doc_words(c.data, c.offsets, model.value, memory)
                label = y[c.rows][who]
                keys, back = np.unique(value, return_inverse=True)
                toxic = np.bincount(back, label, len(keys)).astype(np.int64)
                every = np.bincount(back, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(text.signed(keys)), pa.array(toxic), pa.array(every - toxic)], ["word", "toxic", "clean"])

    return run


def strengths(toxic: np.ndarray, clean: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    """Log odds of standing in a toxic text, held back for rare words; 0 for words of too few."""
    t, c = np.maximum(toxic, 0), np.maximum(clean, 0)
    odds = np.log((t + 0.5) / (totals[0] + 1)) - np.log((c + 0.5) / (totals[1] + 1))
    return np.where((t >= LEAST - 1) & (odds > 0), odds * t / (t + 1.0), 0.0)


FOUND = "row bigint, doc_id bigint, y int, n_words bigint, top array<double>, total double, rare array<bigint>"


def evidence(lexicon, rare, model, with_label: bool):
    """Task function: (row, doc_id, text[, y]) to FOUND: the strongest strengths and the sum of all, of the words in the lexicon, and hashes of other words that may count.

    A label is taken out of the counts first.
    """

    def run(batches):
        memory: dict = {}
        keys, toxic, clean, totals = lexicon.value
        for batch in batches:
            for c in text.chunks(batch.column(2)):
                value, who, n_words = doc_words(c.data, c.offsets, model.value, memory)
                n = len(n_words)
                where = np.minimum(np.searchsorted(keys, value), max(len(keys) - 1, 0))
                known = keys[where] == value if len(keys) else np.zeros(len(value), bool)
                hit = np.flatnonzero(known)
                owner, entry = who[hit], where[hit]
                y = batch.column(3).to_numpy()[c.rows] if with_label else np.zeros(n, np.int32)
                out = y[owner] if with_label else np.zeros(len(owner))
                strong = strengths(toxic[entry] - out, clean[entry] - (1 - out) * with_label, totals)
                order = np.lexsort((-strong, owner))
                owner, strong = owner[order], strong[order]
                begin = np.searchsorted(owner, np.arange(n + 1))
                place = np.arange(len(owner)) - begin[owner]
                top = np.zeros((n, 3))
                for k in range(3):
                    some = place == k
                    top[owner[some], k] = strong[some]
                other = np.flatnonzero(~known & text.may_hold(rare.value, value)) if rare else np.zeros(0, np.int64)
                ids = [batch.column(i).slice(c.rows.start, c.rows.stop - c.rows.start) for i in range(2)]
                rest = text.lists(pa.array(text.signed(value[other])), np.bincount(who[other], minlength=n))
                columns = [*ids, pa.array(y.astype(np.int32)), pa.array(n_words.astype(np.int64)), text.lists(pa.array(top.reshape(-1)), np.full(n, 3)), pa.array(np.bincount(owner, strong, n).astype(np.float64)), rest]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "y", "n_words", "top", "total", "rare"])

    return run


def features(found: DataFrame, rest: DataFrame | None, totals: tuple[int, int], with_label: bool) -> DataFrame:
    """(row, doc_id, y, x) of FOUND: the strongest word, the second, the second and third, all over the root of the words; rest (word, toxic, clean) joins the words outside the lexicon."""
    top, total = F.col("top"), F.col("total")
    if rest is not None:
        found = jobs.cut(found)
        out = (F.col("y"), 1 - F.col("y")) if with_label else (F.lit(0), F.lit(0))
        t, c = F.greatest(F.col("toxic") - out[0], F.lit(0)), F.greatest(F.col("clean") - out[1], F.lit(0))
        odds = F.log((t + 0.5) / (totals[0] + 1)) - F.log((c + 0.5) / (totals[1] + 1))
        strong = F.when((t >= LEAST - 1) & (odds > 0), odds * t / (t + 1.0)).otherwise(0.0)
        more = found.select("row", "y", F.explode("rare").alias("word")).join(rest.hint("merge"), "word").select("row", strong.alias("strong"))
        more = more.groupBy("row").agg(F.sum("strong").alias("more"), F.collect_list("strong").alias("others"))
        found = found.join(more.hint("merge"), "row", "left")
        top = F.slice(F.sort_array(F.concat("top", F.coalesce("others", F.array().cast("array<double>"))), False), 1, 3)
        total = total + F.coalesce("more", F.lit(0.0))
    found = found.select("row", "doc_id", "y", "n_words", top.alias("top"), total.alias("total"))
    return found.select("row", "doc_id", "y", F.array(F.col("top")[0], F.col("top")[1], F.col("top")[1] + F.col("top")[2], F.col("total") / F.sqrt(1 + F.col("n_words"))).alias("x"))


def scored(weights):
    """Task function: (row, doc_id, x) to (row, doc_id, score)."""

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score(weights, x))], ["row", "doc_id", "score"])

    return run


def score(weights, x: np.ndarray) -> np.ndarray:
    """Probabilities by the logistic model, or the one given where there is none."""
    return learn.sigmoid(np.c_[x, np.ones(len(x))] @ weights) if isinstance(weights, np.ndarray) else np.full(len(x), float(weights))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon_size: int = LEXICON, numbered: bool = False) -> DataFrame:
    """(row, doc_id, score) for each row of docs (doc_id long, text), which has numbers of its rows in row if numbered; labels: (doc_id, y) to learn from."""
    spark = docs.sparkSession
    docs = docs if numbered else jobs.with_rows(docs.select("doc_id", "text"))
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("doc_id is not null and y is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    model = spark.sparkContext.broadcast(character_model(docs))
    train = docs.where("doc_id is not null").select("doc_id", "row", "text").mapInArrow(jobs.with_ids(jobs.id_bitmap(known.select("doc_id")), True), "doc_id bigint, row bigint, text string").join(known.hint("merge"), "doc_id").select("row", "doc_id", "text", "y")
    train = jobs.cut(train)
    totals = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    both = (totals.get(1, 0), totals.get(0, 0))
    words = train.select("y", "text").mapInArrow(word_counts(model), "word bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (both[0] + 1)) - F.log((F.col("clean") + 0.5) / (both[1] + 1))
    words = jobs.cut(words.where(F.col("toxic") >= LEAST).where(odds > 0))
    often = (F.col("toxic") + F.col("clean")).alias("often")
    frequent = words.select("word", "toxic", "clean", often).orderBy(F.desc("often"), "word").limit(lexicon_size).toArrow()
    keys = frequent["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    lexicon = spark.sparkContext.broadcast((keys[order], frequent["toxic"].to_numpy()[order], frequent["clean"].to_numpy()[order], both))
    rest = rare = None
    if lexicon_size <= len(frequent):
        last = frequent.select(["often", "word"]).slice(len(frequent) - 1).to_pylist()[0] if len(frequent) else None
        rest = words.where((often < last["often"]) | (often == last["often"]) & (F.col("word") > last["word"])) if last else words
        rare = jobs.bitmap(rest, "word")
    weights = both[0] / max(1, sum(both))
    if min(both):
        some = train.join(train.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct(), "doc_id", "left_semi").select("row", "doc_id", "text", "y")
        x, y = learn.sample(features(some.mapInArrow(evidence(lexicon, rare, model, True), FOUND), rest, both, True), sample)
        weights = learn.logistic(x, y)
    return features(docs.mapInArrow(evidence(lexicon, rare, model, False), FOUND), rest, both, False).select("row", "doc_id", "x").mapInArrow(scored(weights), "row bigint, doc_id bigint, score double")


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read(spark, sf_dir, "labels").where(learn.remainder(MODULUS) != HELD_OUT).select("doc_id", F.col("toxic").alias("y"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    out = classify(jobs.read(spark, sf_dir, "documents"), train_labels(spark, sf_dir))
    return out.select("doc_id", (learn.remainder(MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score below the cut.

    Rows are judged each by its own text, whatever their doc_id, null ones and
    repeated ones too; null and empty texts have no known words, so they stay
    unless most labels are toxic; all columns stay as they are, whatever their
    names; an empty table gives an empty one.
    """
    name = jobs.unused(docs, "row")
    rows = jobs.with_rows(docs, name)
    found = classify(rows.select(F.col(name).alias("row"), "doc_id", "text"), train_labels(spark, sf_dir), numbered=True)
    return jobs.without(rows, name, found.where(F.col("score") >= CUT))
