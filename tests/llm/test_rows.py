"""Rows that repeat ids or have none, columns with the operators' own names, very long and unspaced texts, and skew, against brute force."""

import collections
import hashlib
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("tapeworks.llm")
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import SPACED, components, contamination, held_out, lower, removed, shared_positions
from tokenizers import Tokenizer

from tapeworks.llm import decontaminate, jobs, learn, neardup, packing, pii, quality, queries, substrings, suffixes, text, tokencount, topk, toxicity

#: Names that operators use for columns of their own.
NAMES = ["row", "_row", "base", "spans", "m_email", "p_ip", "s_card", "g_phone", "whole_text", "parts", "ends", "win", "source", "bands", "score", "hit", "salt", "node", "component", "Component_ID", "x", "y", "ids", "fp"]
A, B = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")


def wide(spark, rows, names=NAMES):
    """Rows (doc_id, text) with a column of each name, which hold the row's number as text."""
    kinds = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(d, t, *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)], kinds)


def test_numbers_of_rows(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.row: r.doc_id for r in jobs.with_rows(docs).collect()}
    assert len(one) == docs.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    docs.repartition(3).write.parquet(f"{tmp_path}/d")
    again = {r.row: r.doc_id for r in jobs.with_rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id % 2 = 0")).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == {r: d for r, d in one.items() if d % 2 == 0}
    many = spark.read.parquet(f"{tmp_path}/d")
    assert jobs.with_rows(many).agg(F.countDistinct("row")).first()[0] == docs.count()
    twice = many.select("doc_id").union(many.select("doc_id"))
    assert jobs.with_rows(twice).agg(F.countDistinct("row")).first()[0] == 2 * docs.count()
    pairs = many.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    assert jobs.with_rows(pairs).agg(F.countDistinct("row")).first()[0] == 2 * docs.count()
    assert jobs.unused(spark.createDataFrame([(1, 2)], "ROW int, _row int"), "row") == "__row"


def test_substrings_by_row(spark):
    rows = [(1, A), (2, A + " two words"), (2, B), (3, f"{B} {A}"), (None, A), (None, A), (4, f"x {B}"), (4, f"y {B} {B}"), (-1, None), (5, "z" * 200_000)]
    for common in (100_000, 0):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.dedup(wide(spark, rows), common=common).collect())
        want = []
        first: dict = {}
        for d, t in rows:
            w = SPACED.findall(t or "")
            for a in range(len(w) - 12):
                if d is not None:
                    first[tuple(w[a : a + 13])] = min(d, first.get(tuple(w[a : a + 13]), d))
        for d, t in rows:
            w = SPACED.findall(t or "")
            gone = {x for a in range(len(w) - 12) if d is not None and first[tuple(w[a : a + 13])] < d for x in range(a, a + 13)}
            want.append((str(d), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert got == sorted(want)


def test_suffixes_by_row(spark):
    long = " ".join(f"c{i}" for i in range(70))
    rows = [(1, f"{long} {A}"), (2, f"u v {long}"), (2, B), (2, f"{B} {B}"), (3, f"k {B} {long} {A}"), (None, long), (4, None), (5, "q" * 100_000), (6, f"{A} {B}"), (6, f"{A} {B}")]
    got = [(r.doc_id, r.start, r.length, r.match_doc_id) for r in suffixes.repeats(wide(spark, rows)).collect()]
    assert sorted(got) == [(1, 0, 110, 2), (2, 2, 70, 1), (3, 41, 110, 1)]


def test_near_duplicates_by_row(spark):
    other = " ".join(f"d{i}" for i in range(60))
    rows = [(5, A), (5, B), (3, A + " x"), (None, B + " y"), (None, "alone with no number at all"), (None, None), (9, " "), (9, " "), (7, other), (7, other), (2, "w" * 100_000)]
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(wide(spark, rows), 3, 85).collect())
    assert got == collections.Counter([(5, 38, 3), (5, 38, 5), (3, 39, 3), (None, 39, 5), (None, 4, None), (None, 0, None), (9, 0, 9), (9, 0, 9), (7, 58, 7), (7, 58, 7), (2, 1, 2)])
    docs = wide(spark, rows)
    kept = neardup.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect() if r.text != " ") == sorted([("3", A + " x"), ("5", B), ("None", "alone with no number at all"), ("None", "None"), ("7", other), ("2", "w" * 100_000)])
    assert sum(r.text == " " for r in kept.collect()) == 2


@pytest.mark.parametrize("spoiled", [3, 60])
def test_large_buckets(spark, spoiled):
    """Near copies of one text and of others, in buckets of many blocks, with and without a centre."""
    rng = np.random.default_rng(spoiled)
    rows = []
    for d in range(400):
        w = [f"w{i}" for i in range(100)] if d % 4 else [f"w{i}" for i in range(70)] + [f"v{i}" for i in range(30)]
        for p in rng.integers(0, 100, rng.integers(0, 4) if d % 10 else spoiled // 3):
            w[p] = f"x{rng.integers(100_000)}"
        rows.append((d, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows, 3, 85)


def test_contamination_by_row(spark):
    items = [(1, A), (2, "the"), (3, "the the"), (4, "the"), (5, " ".join(A.split()[5:17])), (None, B)]
    rows = [(1, A), (1, B), (None, f"x {A}"), (None, "the end"), (2, "the the the cat the"), (3, None), (4, "e" * 300_000), (5, "the " * 5000 + A)] + [(10 + i, f"the notice {A} of {i} the") for i in range(60)]
    want = contamination([(i, t) for i, (_, t) in enumerate(rows)], [x for x in items if x[0] is not None])
    for carried in (100_000, 0):
        docs = jobs.with_rows(wide(spark, rows, ["n", *NAMES[1:]]).withColumn("n", F.monotonically_increasing_id()).select("doc_id", "text"))
        found = decontaminate.by_row(docs, spark.createDataFrame(items, "item_id long, text string"), carried=carried).collect()
        cover = lambda spans: len({x for s in spans for x in range(s.start, s.end)})
        assert sorted((r.n_words, cover(r.spans), r["items"]) for r in found) == sorted(x[1:] for x in want)


def test_stages_filter_rows(spark, sf, tmp_path):
    """Contaminated and toxic rows go whatever their id, others stay; all columns stay."""
    bench = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    item = max((t for _, t in bench), key=len)
    rows = [(1, item), (None, f"so {item}"), (1, "clean words of no test at all"), (None, None), (2, "")]
    docs = wide(spark, rows)
    kept = decontaminate.drop_contaminated(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "clean words of no test at all"), ("2", ""), ("None", "None")]
    known = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    real = [(r.doc_id, r.text) for r in known.collect()]
    docs = wide(spark, [*real, *[(None, t) for _, t in real[:40]], (real[0][0], "other words")])
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = toxicity.classify(docs, toxicity.train_labels(spark, sf)).collect()
    kept = toxicity.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score < toxicity.CUT for r in found)
    numbered = {r.row: (r.doc_id, r.text) for r in jobs.with_rows(docs.select("doc_id", "text")).collect()}
    assert collections.Counter(numbered[r.row] for r in found if r.score < toxicity.CUT) == collections.Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())


def redacted(t):
    only = lambda m: re.sub(r"\D", "", m)
    spans = [(m.start(), m.end(), k) for k, p, good in [("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15)] for m in re.finditer(p, t) if good(m.group())]
    out, at = "", 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += t[at:a] + f"[{k}]"
        at = max(at, b)
    return out + t[at:]


def test_redaction(spark, sf):
    some = ["mail a@b.cd, 1.2.3.4 and +1 (974) 555-3436", "é😀 1.2.3.4", None, "", "x" * 100_000, "1.2.3.4 " * 3000, "a@b.c " * 255 + "1.2.3.4", "a@b.c " * 256, "a@b.c " * 257 + "end", "u@1.2.3.4.5 +1.2.3.4.567 89"]
    docs = wide(spark, [(i % 2, t) for i, t in enumerate(some)], [*NAMES, "n_chars"]).withColumn("n_chars", F.lit(0).cast("long"))
    got = pii.redact(spark, docs, sf)
    assert got.columns == docs.columns
    rows = {r.base: r for r in got.collect()}
    for i, t in enumerate(some):
        r = rows[f"base{i}"]
        assert r.text == (None if t is None else redacted(t)) and r.n_chars == (None if t is None else len(redacted(t)))
        assert [r[n] for n in NAMES] == [f"{n}{i}" for n in NAMES]


def test_context_decides(spark):
    card = "GB82 WEST 1234 5698 7654 32"
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    cases = {f"iban {card}": [("iban", 85)], f"so {card}": [("iban", 70)], f'token = "{key}"': [("secret", 70)], f"so {key}": [], "my SSN is 123-45-6789": [("ssn", 65)], "part 123-45-6789": [], "ssn 000-45-6789": [], "ssn 1123-45-6789": [], "host 1.2.3.4": [("ip", 75)], "so 1.2.3.4": [("ip", 60)], "monkey " + "a" * 30: [], f"MONKEY {key}": []}
    found = pii.find(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.kind, round(100 * s.score)) for s in r.spans] for r in found} == dict(enumerate(cases.values()))


def test_many_matches_cost_no_square(spark):
    df = spark.createDataFrame([(1, "1.2.3.4 " * 200_000)], "doc_id long, text string")
    start = time.perf_counter()
    assert pii.find(df).select(F.size("spans")).first()[0] == 200_000
    assert time.perf_counter() - start < 60


def test_tokens_of_the_whole_table(spark, sf):
    """The registered query against one loop over pre-tokens, and a megabyte without a space."""
    pieces = tokencount.vocabulary(public_tokenizers.path(tokencount.MODEL))
    longest, known = max(map(len, pieces)), {}

    def best(word):
        b, at = b" " + word, [(0, 0)]
        for i in range(1, len(b) + 1):
            own = [(at[i - n][0] + pieces[b[i - n : i]], at[i - n][1] - 1) for n in range(1, min(longest, i) + 1) if b[i - n : i] in pieces]
            at.append(max([(at[i - 1][0] + tokencount.BYTE, at[i - 1][1] - 1), *own]))
        return -at[-1][1]

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rng = np.random.default_rng(1)
    odd = [(-1, "".join(map(chr, rng.integers(97, 123, n)))) for n in (127, 128, 129, 1000, 5000)] + [(-2, "日本語の文章" * 300)]
    want = []
    for d, t in [*docs, *odd]:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((d, len(words), sum(known.get(w) or known.setdefault(w, best(w)) for w in words)))
    got = [tuple(r) for r in queries.QUERIES["op3_token_counts"](spark, sf).collect()] + [tuple(r) for r in tokencount.token_counts(wide(spark, odd)).collect()]
    assert sorted(got) == sorted(want)
    start = time.perf_counter()
    n = tokencount.token_counts(spark.createDataFrame([(1, "".join(map(chr, rng.integers(97, 123, 1 << 20))))], "doc_id long, text string")).first().n_tokens
    assert n > 200_000 and time.perf_counter() - start < 30


def test_packing_of_the_whole_table(spark, sf):
    """The registered query: each document's ids are those of the tokenizer, cut as told, with little padding."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()}
    rows, filled, held = queries.QUERIES["op2_packing"](spark, sf).collect(), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        filled[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id].append((r.start, r.length))
    for d, parts in held.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == len(want[d])
    assert held.keys() == want.keys()
    for pieces in filled.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] in [1 << i for i in range(11)]


def test_top_k_in_any_pieces(spark):
    """Small blocks, slices and groups, repeated ids and vectors, several lengths, columns of the operator's own names."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 9, 3 if i % 5 else 6) / 16]) for i in rng.integers(0, 300, 700)] + [(50, [0.5, 0.25, 0.0])] * 200 + [(7, None), (8, [])]
    df = spark.createDataFrame([(i, v, 1, "s", 2) for i, v in rows], "vec_id long, embedding array<double>, row int, slice string, dim int")
    vectors = topk.integers(df)
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5, block=400, slice_bytes=1500, group_bytes=300).collect())
    assert got == sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v]
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:
        mine = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in whole if i != q and len(v) == len(mine))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    plan = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_quality_against_loops(spark, sf):
    """Context vectors, pooling and scores, worked out token by token."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()[:60] + [(900, None), (901, ""), (902, "One, two2 THREE!")]
    index = quality.index_vectors()
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 2 if 0x30 <= b <= 0x39 else 3

    def rows_of(t):
        raw, out, at = (t or "").encode(), [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and kind(raw[end]) == kind(raw[at]):
                end += 1
            if kind(raw[at]):
                part = raw[at:end]
                h = int(text.hash_spans(np.frombuffer(part, np.uint8), np.array([0]), np.array([len(part)]))[0])
                caps = sum(0x41 <= b <= 0x5A for b in part)
                case = 0 if not caps else 1 if caps == len(part) else 2 if caps == 1 and 0x41 <= part[0] <= 0x5A else 3
                out.append((h % quality.ROWS, quality.ROWS + ((kind(part[0]) * 4 + case) * 4 + min(3, len(part) // 3)) % quality.SHAPES))
            at = end
        return out

    tokens = [rows_of(t) for _, t in docs]
    context = np.zeros_like(index, np.float64)
    for doc in tokens:
        for one, two in zip(doc, doc[1:], strict=False):
            for a, b in ((one, two), (two, one)):
                for row in a:
                    context[row] += index[b[0]] + index[b[1]]
    table = np.concatenate([context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1), index / 2], axis=1)
    want = []
    for doc in tokens:
        n = len(doc)
        mean = sum(table[w] + table[s] for w, s in doc) / n if n else np.zeros(table.shape[1])
        want.append([*mean, len({w for w, _ in doc}) / min(n, quality.ROWS) if n else 0, np.log1p(n)])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.x for r in quality.vectors(df).collect()}
    for (d, _), x in zip(docs, want, strict=True):
        assert np.allclose(got[d], x, atol=1e-4), d
    labels = [(d, int(d % 3 == 0)) for d, _ in docs if d < 900]
    a, y = learn.sample(spark.createDataFrame([(d, list(map(float, got[d])), dict(labels)[d]) for d, _ in labels], "doc_id long, x array<double>, y int"), quality.SAMPLE)
    model = learn.network(a, y)
    scores = {r.doc_id: r.score for r in quality.classify(df, spark.createDataFrame(labels, "doc_id long, y int")).collect()}
    for d, _ in docs:
        z = (np.array(got[d]) - model["mean"]) / model["spread"]
        logit = np.tanh(z @ model["net"][0] + model["net"][1]) @ model["net"][2] + model["net"][3]
        assert abs(scores[d] - 1 / (1 + np.exp(-logit / model["temperature"]))) < 1e-3


def readings_of(token, model):
    """Every way to read a token and its score, one by one."""
    ways = [([], 0.0)]
    for c, before in zip(token, "\0" + token, strict=False):
        ways = [(w + ([x] if x else []), s + cost) for w, s in ways for x, cost in toxicity.readings(c, before)]
    for letters, cost in ways:
        a = b = 0
        score = cost
        for x in letters:
            n = toxicity.letter(x)
            score += model[a, b, n]
            a, b = b, n
        yield "".join(letters), score + model[a, b, 0]


def test_decoding_against_every_reading(spark, sf):
    model = toxicity.character_model(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    for token in ["$tup1d", "m.o.r", "tr@sh", "1d10t", "heeel", "a55", "b!g", "sooo", "l|e", "0+0"]:
        found = dict()
        for word, score in readings_of(token, model):
            found[word] = max(score, found.get(word, -1e9))
        assert abs(found[toxicity.decode(token, model)] - max(found.values())) < 1e-9, token


def test_toxicity_against_loops(spark, sf):
    """Words, counts, features and scores, worked out document by document."""
    import pyarrow as pa

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    labels = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    model = toxicity.character_model(spark.createDataFrame(docs, "doc_id long, text string").select("text"))
    words, number = {}, {}
    for d, t in docs:
        c = next(text.chunks(pa.array([t or ""])))
        value, _, n = toxicity.doc_words(c.data, c.offsets, model, {})
        plain = re.findall(rb"[a-z\x80-\xff]+", toxicity.fold(np.frombuffer((t or "").encode(), np.uint8)).tobytes()) if t else []
        assert int(n[0]) == len(plain)
        words[d], number[d] = set(value.tolist()), len(plain)
        hashed = [int(text.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in set(plain)]
        assert set(hashed) <= words[d]
    known = dict(labels)
    totals = [sum(y == 1 for y in known.values()), sum(y == 0 for y in known.values())]
    counts = collections.defaultdict(lambda: [0, 0])
    for d, y in known.items():
        for w in words[d]:
            counts[w][1 - y] += 1
    odds = lambda t, c: np.log((t + 0.5) / (totals[0] + 1)) - np.log((c + 0.5) / (totals[1] + 1))
    lexicon = {w: v for w, v in counts.items() if v[0] >= toxicity.LEAST and odds(*v) > 0}

    def x(d, y=None):
        strong = []
        for w in words[d] & lexicon.keys():
            t, c = lexicon[w]
            t, c = (max(t - (y == 1), 0), max(c - (y == 0), 0)) if y is not None else (t, c)
            strong.append(odds(t, c) * t / (t + 1) if t >= toxicity.LEAST - 1 and odds(t, c) > 0 else 0.0)
        top = sorted(strong, reverse=True)[:3] + [0, 0, 0]
        return [top[0], top[1], top[1] + top[2], sum(strong) / np.sqrt(1 + number[d])]

    ids = sorted(known)
    weights = learn.logistic(np.array([x(d, known[d]) for d in ids]), np.array([float(known[d]) for d in ids]))
    want = {d: float(learn.sigmoid(np.r_[x(d), 1] @ weights)) for d, _ in docs}
    got = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d].score - want[d]) < 1e-6 and got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in want)


def test_pipeline_effects(spark, sf, tmp_path):
    """Each stage's decisions take effect on all that the one before kept, down to the packed ids."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, sf).write.parquet(f"{tmp_path}/{name}")
        seen = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
    texts = {n: {r.doc_id: r.text for r in kept[n].collect()} for n in list(stages)[:-1]}
    judged = {r.doc_id for r in toxicity.classify(docs, toxicity.train_labels(spark, sf)).where(F.col("score") < toxicity.CUT).collect()}
    assert texts["toxicity"].keys() == judged
    near = components([(d, t) for d, t in texts["toxicity"].items()], 5, 80)
    assert texts["near_duplicates"].keys() == {d for d, (n, c) in near.items() if c == d}
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    clean = {d for d, _, hit, _ in contamination(list(texts["near_duplicates"].items()), items) if not hit}
    assert texts["decontamination"].keys() == clean and len(clean) < len(texts["near_duplicates"])
    assert texts["personal_data"].keys() == clean
    found = {r.doc_id: r.spans for r in pii.find(kept["decontamination"]).collect()}
    for d, t in texts["personal_data"].items():
        assert (t == texts["decontamination"][d]) == (not found[d])
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t or "")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = collections.defaultdict(list)
    for r in kept["packing"].collect():
        packed[r.doc_id].append((r.start, r.ids))
    assert packed.keys() == texts["personal_data"].keys()
    for d, t in texts["personal_data"].items():
        assert [x for _, ids in sorted(packed[d]) for x in ids] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
