"""The operators' results, or their base columns, as SQL for DuckDB.

op4 and op10 add columns of a fitted model, op3 a trained score; queries named base_ give the rest of
their columns, which SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.lines import MIN_WORDS, PERCENT
from sablefin.llm.secrets import THRESHOLDS, WINDOW
from sablefin.llm.shared import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"


def lowered(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT a AS v, a AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least.r, s.doc_id) AS component_id, coalesce(least.r, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN least ON s.doc_id = least.v
"""

HEX_DIGITS, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NIBBLE = f"(instr('{HEX_DIGITS}', substr(h, (5 * i) // 4 + %d, 1)) - 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(encode(coalesce(html, ''))) AS h, coalesce(nullif(url, ''), 'about:blank') AS u FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM p)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', CAST(1 + (((16 * {NIBBLE % 1} + {NIBBLE % 2}) >> (3 - (5 * i) % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
  array_to_string(list_transform(string_split(u, ''), lambda c: CASE WHEN ascii(c) <= 32 OR ascii(c) = 127 THEN printf('%%%02X', ascii(c)) ELSE c END), '') AS url, TRUE AS verified
FROM g
"""

LINES = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS x, unnest(range(len(x))) AS line FROM d),
s AS (SELECT doc_id, line, list_distinct(regexp_extract_all(lower(x), '{WORD}')) AS s FROM l),
k AS (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, s, len(s) AS n FROM s WHERE len(s) >= {MIN_WORDS}),
w AS (SELECT id, n, unnest(s) AS w FROM k),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
r AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS i FROM w JOIN f USING (w)),
p AS (SELECT id, n, w FROM r WHERE i <= n - (n * {PERCENT} + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id, b.id AS b FROM p a JOIN p b ON a.w = b.w AND b.id < a.id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
m AS (
  SELECT DISTINCT c.id FROM c JOIN k x ON x.id = c.id JOIN k y ON y.id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= {PERCENT} * (x.n + y.n - len(list_intersect(x.s, y.s)))),
o AS (SELECT doc_id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM m JOIN k USING (id) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.x), 0) AS BIGINT) AS n_lines, coalesce(o.n, 0) AS n_removed, coalesce(o.removed, '') AS removed
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


def located(name: str, pattern: str) -> str:
    """Columns with the gaps and matches of a pattern by turns, and their ends in code points."""
    parts = f"string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1))"
    return f"{parts} AS {name}_parts, list_transform(range(0, len({parts}) + 1), lambda i: coalesce(list_sum(list_transform({parts}[1:i], lambda y: length(y))), 0)) AS {name}_ends"


def spans(name: str, order: int) -> str:
    return f"list_transform(range(2, len({name}_parts) + 1, 2), lambda i: {{'s': CAST({name}_ends[i] AS BIGINT), 'k': {order}, 'kind': '{name}', 'e': CAST({name}_ends[i + 1] AS BIGINT), 't': {name}_parts[i]}})"


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def written(spans_: str) -> str:
    return f"array_to_string(list_transform(list_sort({spans_}), lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"


NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = f"(?:{NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
WINDOWS = f"list_max(list_transform(range(1, greatest(2, length(x.t) - {WINDOW - 2})), lambda i: list_aggregate(string_split(substr(x.t, i, {WINDOW}), ''), 'entropy')))"
ALLOWED = " OR ".join(
    f"regexp_matches(x.t, '{p}')"
    for p in (
        "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "^[^0-9]*$", "^[^A-Za-z]*$",
        "|".join([*map(either_case, ("example", "placeholder", "changeme")), "[xX]{6}", "0{8}", "1234567890"]),
    )
)
SECRETS = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
p AS (SELECT doc_id, {located("assign", ASSIGN)}, {located("access", "AKIA[A-Z0-9]+")}, {located("hex", "[0-9a-f]{32,}")}, {located("entropy", "[A-Za-z0-9+/_=-]{20,}")} FROM t),
f AS (
  SELECT doc_id, list_filter({spans("assign", 0)}, lambda x: length(regexp_extract(x.t, '{ASSIGN}', 1)) >= 8) AS assign,
    list_filter({spans("access", 1)}, lambda x: length(x.t) >= 16) AS access, {spans("hex", 2)} AS hex, {spans("entropy", 3)} AS candidates FROM p),
b AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base FROM f),
e AS (
  SELECT *, list_filter(candidates, lambda x: len(list_filter(base, lambda y: y.s < x.e AND x.s < y.e)) = 0 AND NOT ({ALLOWED}) AND {WINDOWS} >=
    CASE WHEN regexp_matches(x.t, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS["hex"]} WHEN regexp_matches(x.t, '^[A-Za-z0-9]+$') THEN {THRESHOLDS["alnum"]} ELSE {THRESHOLDS["base64"]} END) AS new FROM b)
SELECT doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex,
  sha256({written("base")}) AS base_sha256, {written("list_concat(base, new)")} AS spans, CAST(len(new) AS BIGINT) AS n_entropy
FROM e
"""

QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x FROM t),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS m, unnest(range(5)) AS k FROM v) WHERE m > 1 GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""

DIGITS = "regexp_replace(x.t, '[^0-9]', '', 'g')"
DIGIT = f"CAST(substr({DIGITS}, length({DIGITS}) - i, 1) AS BIGINT)"  # from the right, the last one at 0
LUHN = f"list_sum(list_transform(range(length({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {DIGIT} WHEN {DIGIT} > 4 THEN 2 * {DIGIT} - 9 ELSE 2 * {DIGIT} END)) % 10 = 0"
PERSONAL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
p AS (
  SELECT doc_id, {located("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")}, {located("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")},
    {located("card", "[0-9](?:[ -]?[0-9])+")}, {located("phone", "[+][0-9][ ().0-9-]+[0-9]")} FROM t),
f AS (
  SELECT doc_id, {spans("email", 0)} AS email,
    list_filter({spans("ip", 1)}, lambda x: len(list_filter(string_split(x.t, '.'), lambda y: TRY_CAST(y AS HUGEINT) IS NULL OR TRY_CAST(y AS HUGEINT) > 255)) = 0) AS ip,
    list_filter({spans("card", 2)}, lambda x: length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}) AS card,
    list_filter({spans("phone", 3)}, lambda x: length({DIGITS}) BETWEEN 9 AND 15) AS phone FROM p)
SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip, CAST(len(card) AS BIGINT) AS n_card, CAST(len(phone) AS BIGINT) AS n_phone,
  sha256({written("list_concat(list_concat(email, ip), list_concat(card, phone))")}) AS base_sha256
FROM f
"""

ORACLE = {
    "op1_near_dedup": NEAR, "op2_warc": WARC, "op8_line_dedup": LINES, "op9_secrets": SECRETS,
    "base_of_op4_quality": QUALITY, "base_of_op10_pii": PERSONAL,
}


def base_of_op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablefin.llm.quality import op4_quality

    return op4_quality(spark, sf_dir).drop("kept", "llr")


def base_of_op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sablefin.llm.pii import op10_pii

    return op10_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in ("email", "ip", "card", "phone")], F.col("base_sha256"))
