"""What operators return, as SQL for DuckDB: plain text matching, with neither hashes, signatures nor anchors."""

from . import topk

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words hold no blanks, so joined words are equal only if the words are.
DOCS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({text}, '{word}'), []) AS w FROM documents)"

OP1_SQL = rf"""
WITH {DOCS.format(text=LOWER, word=PLAIN)},
item AS (SELECT item_id, regexp_extract_all({LOWER}, '{PLAIN}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
item_win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[a:a + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS a FROM sized)),
doc_win AS (SELECT r, n, a, array_to_string(w[a:a + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM item_win))),
hit AS (SELECT DISTINCT r, a, n, item FROM doc_win JOIN item_win USING (n, win)),
word AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS place FROM hit) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN held USING (r)"""

OP5_SQL = rf"""
WITH RECURSIVE {DOCS.format(text=LOWER, word=SPACED)},
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]), lambda x: concat(x[1], ' ', x[2], ' ', x[3])))) END AS s FROM d),
class AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
shingle AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM class),
-- linked sets share one of each one's rarest shingles: of n, all but 85% and one more
rare AS MATERIALIZED (SELECT rep, n, x FROM (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY held, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS held FROM shingle)) WHERE k <= n - (85 * n + 99) // 100 + 1),
near AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare AS a JOIN rare AS b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared AS (SELECT a, b, p.n + q.n AS n, len(list_intersect(p.s, q.s)) AS c FROM near JOIN class AS p ON p.rep = a JOIN class AS q ON q.rep = b),
pair AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * c >= 85 * (n - c)),
link AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
part AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN class ON sets.s = class.s LEFT JOIN part ON class.rep = part.rep"""

OP8_SQL = rf"""
WITH {DOCS.format(text="text", word=SPACED)},
win AS (SELECT r, doc_id, a, array_to_string(w[a:a + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS a FROM d)),
seen AS (SELECT r, a, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM win),
gone AS (SELECT DISTINCT r, unnest(range(a, a + 13)) AS place FROM seen WHERE again),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""


def spans(kind: str, pattern: str, check: str, text: str = "t") -> str:
    """Two common tables that locate one kind's matches by the lengths of matches and of pieces between."""
    return rf"""
m_{kind} AS (SELECT r, i, m[i] AS x, length(m[i]) AS n, length(p[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
  FROM (SELECT r, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS p FROM d))),
s_{kind} AS (SELECT r, '{kind}' AS kind, starts, starts + n AS ends FROM (SELECT r, x, n, CAST(sum(gap + n) OVER (PARTITION BY r ORDER BY i) - n AS BIGINT) AS starts, regexp_replace(x, '[^0-9]', '', 'g') AS digits FROM m_{kind}) WHERE {check})"""


DIGIT = "CAST(substr(digits, length(digits) - i, 1) AS INTEGER)"
LUHN = f"list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN {DIGIT} ELSE 2 * {DIGIT} - CASE WHEN {DIGIT} > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
BARE = "replace(x, ' ', '')"
TURNED = f"concat(substr({BARE}, 5), substr({BARE}, 1, 4))"
MOD_97 = f"list_reduce(list_transform(string_split({TURNED}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda v, c: CASE WHEN c < 58 THEN (v * 10 + c - 48) % 97 ELSE (v * 100 + c - 55) % 97 END, 0::BIGINT) = 1"
KINDS = ["email", "ip", "card", "phone"]


def scored() -> str:
    """One more column for every span: its score, by the words in the characters before it."""
    from . import pii

    kinds = [*pii.BASE, *pii.ADDED]
    near = f"lower(substr(t, greatest(starts - {pii.LOOK}, 0) + 1, least(starts, {pii.LOOK})))"
    base = " ".join(f"WHEN '{k.name}' THEN {k.score}" for k in kinds)
    lift = " ".join(f"WHEN kind = '{k.name}' AND regexp_matches({near}, '(?:^|[^a-z0-9_])(?:{k.context})') THEN {k.lift}" for k in kinds)
    return f"SELECT *, CASE kind {base} END + CASE {lift} ELSE 0 END AS score FROM every JOIN (SELECT r, t FROM d) USING (r)"


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")},
{spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(x, '.'), lambda part: CAST(part AS HUGEINT))) <= 255")},
{spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(digits) BETWEEN 13 AND 19 AND {LUHN}")},
{spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15")},
{spans("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", f"length({BARE}) BETWEEN 15 AND 34 AND {MOD_97}", "replace(t, '_', '-')")},
{spans("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$')")},
{spans("secret", r"[A-Za-z0-9_-]{20,}", "length(digits) >= 4 AND length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 4")},
every AS ({" UNION ALL ".join(f"SELECT {n} AS k, * FROM s_{kind}" for n, kind in enumerate([*KINDS, "iban", "ssn", "secret"]))}),
kept AS (SELECT * FROM ({scored()}) WHERE k < 4 OR score >= 0.5),
told AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)},
  string_agg(concat(kind, ':', starts, ':', ends), ',' ORDER BY k, starts) FILTER (WHERE k < 4) AS base, string_agg(concat(kind, ':', starts, ':', ends), ',' ORDER BY k, starts) AS spans, string_agg(CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR), ',' ORDER BY k, starts) AS scores FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN told USING (r)"""

ORACLES = {"op1_decontamination": OP1_SQL, "op5_minhash_neardup": OP5_SQL, "op6_exact_topk": topk.OP6_SQL, "op7_pii": OP7_SQL, "op8_substring_dedup": OP8_SQL}
