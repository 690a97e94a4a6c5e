"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, secret_ledger

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(place % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER earlier, 0) AS room, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER earlier, 0) AS pull
  FROM w WINDOW earlier AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(room / pull, (cap / weight, place)) AS height FROM l WHERE room / pull <= cap / weight
), t AS (
  SELECT l.source, source_size, CASE WHEN height IS NULL OR cap <= weight * height THEN cap ELSE weight * height END AS target FROM l, level
), r AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN size = 0 THEN (start <= target)::INT ELSE greatest(0, least(3, floor((target - (start + size / 2)) / source_size) + 1))::INT END AS copies FROM r
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""

_TEMPLATES = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.TEMPLATES)


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"


_GRAMS = "list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"


OP7 = rf"""
WITH t AS (SELECT name, {_GRAMS} AS grams FROM (SELECT name, {_words('text')} AS words FROM (VALUES {_TEMPLATES}) AS v(name, text))),
p AS (
  SELECT doc_id, unnest(list_distinct(list_concat([text], string_split(text, chr(10)),
    string_split(regexp_replace(text, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(30), 'g'), chr(30))))) AS passage
  FROM documents WHERE text IS NOT NULL
), g AS (SELECT doc_id, passage, {_GRAMS} AS grams FROM (SELECT *, {_words('passage')} AS words FROM p)),
m AS (
  SELECT doc_id, passage, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g, t WHERE len(g.grams) BETWEEN len(t.grams) / 2 AND 2 * len(t.grams)
), h AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS best, count(DISTINCT passage) AS n FROM m WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id
)
SELECT d.doc_id, coalesce(names, '') AS licenses, round(coalesce(best, 0), 6)::DOUBLE AS best_dice, coalesce(n, 0)::BIGINT AS n_passages
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id
"""


def _rule(number: int, rule: secret_ledger.Rule) -> str:
    pattern = _quoted(rule.pattern)
    start = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))"
    spans = f"list_transform(list_filter(range(1, len(m) + 1), lambda i: length(v[i]) >= {rule.least}), lambda i: {{'start': {start}, 'stop': {start} + length(m[i])}})"
    return rf"""
SELECT doc_id, '{rule.kind}' AS kind, {number} AS ord, unnest({spans}) AS span FROM (
  SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS v, string_split_regex(t, {pattern}) AS g FROM texts
  WHERE regexp_matches(t, {pattern}))"""


_BASE = ", ".join(_quoted(r.kind) for r in secret_ledger.BASE)
_SHOWN = "kind || ':' || span.start || ':' || span.stop"
OP10 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_rule(i, r) for i, r in enumerate(secret_ledger.RULES))}),
a AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE)},
    string_agg({_SHOWN}, ',' ORDER BY span.start, ord) FILTER (kind IN ({_BASE})) AS base, string_agg({_SHOWN}, ',' ORDER BY span.start, ord) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in secret_ledger.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""

#: CRC-32 of a text in SQL: the table of single bytes, then one step a byte.
_CRC_TABLE = (
    "SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], "
    "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crcs"
)


def _crc32(text: str) -> str:
    """CRC-32 of a text beside a column ``crcs`` with the table."""
    code = f"hex(encode({text}))"
    steps = f"list_transform(range(0, len({code}), 2), lambda i: ('0x' || substr({code}, i + 1, 2))::UBIGINT)"
    return (
        f"xor(list_reduce(list_concat([4294967295::UBIGINT], {steps}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"
    )


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP12 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM documents
), m AS (
  SELECT list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM benchmark
), df AS (SELECT doc_id, unnest({_FEATURES}) AS f FROM d), mf AS (SELECT unnest({_FEATURES}) AS f FROM m),
b AS (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM mf), ({_CRC_TABLE})),
s AS (SELECT bucket, count(*) AS s FROM df JOIN b USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM mf JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM mf) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM b) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), e AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
a AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN e USING (doc_id)
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM a WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM r) * 25 // 100 THEN place END AS rank FROM a LEFT JOIN r USING (doc_id)
"""

OP13 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), ({_CRC_TABLE})
), b AS (
  SELECT c.conv_id, 0 AS part, p, r, x FROM c JOIN t ON t.conv_id = head AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND p > h
), n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, sha256(len(r) || ':' || r || x) AS turn, len(x) AS chars FROM b),
path AS (
  SELECT conv_id, d, chars, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM n
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), v AS (
  SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM path) GROUP BY key, d
), k AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (key)),
u AS (SELECT left(key, 64 * i) AS key, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (key) LEFT JOIN v AS p ON w.d > 0 AND p.key = left(w.key, 64 * (w.d - 1))
"""

STATEMENTS = {"op6_mixing": OP6, "op7_licenses": OP7, "op10_secret_ledger": OP10, "op12_importance": OP12, "op13_prefix_trie": OP13}
