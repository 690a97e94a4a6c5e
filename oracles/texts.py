"""Statements for tokenisers, predicates, similarity and lookups."""

from __future__ import annotations

from lodestar.functions import paths as P
from lodestar.functions import text as X
from lodestar.operators import signals as SG

from .parts import CODE_STOP, LINE_START, MODULE, QUERY_STOP, STEM, TITLE, code_terms, code_tokens, set_tokens, with_parts, words

S: dict[str, str] = {}

IDENT = """(SELECT p_partkey, upper(w1[1]) || w1[2:] || upper(w2[1]) || w2[2:] || p_type || '_' || lower(p_type) || '_v' || p_partkey AS ident
  FROM (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part))"""
S["camel_tokens"] = f"SELECT p_partkey, term, count(*) AS cnt FROM ({code_tokens(IDENT, 'p_partkey', 'ident')}) GROUP BY ALL"
S["code_terms"] = "SELECT p_partkey, term, count(*) AS cnt FROM (" + code_terms(
    IDENT.replace("AS ident", "AS raw_ident"), "p_partkey", "raw_ident") + ") GROUP BY ALL"
S["document_token_sets"] = f"SELECT doc_id, count(*) AS n_tokens, min(term) AS first_term FROM ({set_tokens('documents', 'doc_id', 'text')}) GROUP BY doc_id"
S["keyword_sets"] = f"""
  SELECT conv_id, turn, coalesce(string_agg(term, ' ' ORDER BY term), '') AS keywords FROM conversations LEFT JOIN (
    {set_tokens('conversations', 'conv_id, turn', 'text', words(X.KEYWORD_STOPWORDS), X.KEYWORD_TOKEN)}) USING (conv_id, turn) GROUP BY conv_id, turn"""
S["index_identifiers"] = f"""
  SELECT ident, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(i) AS ident FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{X.INDEX_IDENTIFIER}')) AS i FROM documents)) GROUP BY ident"""

MARKS = "regexp_replace(replace({0}, '\\', '/'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"


def pieces(expr: str) -> str:
    return f"unnest(string_split_regex({MARKS.format(expr)}, '[^A-Za-z0-9]+'))"


def weights(source: str) -> str:
    """CTEs ending in ``weights(query_id, term, weight)`` for source(query_id, text)."""
    ends = "\\.(" + "|".join(s[1:] for s in P.INDEX_SUFFIXES) + ")$"
    exts = "|".join(s[1:] for s in P.INDEX_SUFFIXES)
    return f"""
  w_src AS MATERIALIZED (SELECT query_id, text FROM {source}),
  w_quoted AS (SELECT DISTINCT query_id, lower(p) AS word FROM (SELECT query_id, {pieces('q')} AS p FROM (
    SELECT query_id, unnest(regexp_extract_all(text, '[`''"]([^`''"]{{3,120}})[`''"]', 1)) AS q FROM w_src)
    WHERE len(string_split_regex(trim(q, ' '), '\\s+')) <= 4)),
  w_run AS (SELECT query_id, r FROM (SELECT query_id, unnest(regexp_extract_all(text, '{SG.WORD_RUN}')) AS r FROM w_src)
    WHERE regexp_matches(r, '^[A-Za-z_]') AND length(r) >= 3),
  w_sym AS MATERIALIZED (SELECT query_id, lower(r) AS sym FROM w_run WHERE lower(r) NOT IN ({QUERY_STOP})
    AND (contains(r, '_') OR regexp_matches(r, '^[A-Z]')
      OR EXISTS (SELECT 1 FROM w_quoted q WHERE q.query_id = w_run.query_id AND q.word = lower(w_run.r)))),
  w_exc AS (SELECT query_id, e FROM (SELECT query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS e FROM w_src)
    WHERE regexp_matches(e, '{SG.EXCEPTION_NAME}')),
  w_dot AS MATERIALIZED (SELECT query_id, d FROM (SELECT query_id, unnest(regexp_extract_all(text, '{SG.DOTTED_NAME}', 1)) AS d FROM w_src)
    WHERE NOT regexp_matches(lower(d), '{ends}')),
  w_path AS MATERIALIZED (SELECT query_id, regexp_replace(p, '^[./]+|[./]+$', '', 'g') AS p FROM (SELECT query_id,
    unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z0-9_./-]+\\.(?:{exts}))(?:[^A-Za-z0-9_]|$)', 1)) AS p FROM w_src)),
  w_all AS (
    SELECT query_id, {pieces('text')} AS t, 1e0 AS w FROM w_src UNION ALL
    SELECT query_id, {pieces("regexp_replace(p, '[.][^./]*$', '')")}, 5e0 FROM w_path UNION ALL
    SELECT query_id, {pieces('d')}, 4e0 FROM w_dot UNION ALL
    SELECT query_id, sym, 3e0 FROM w_sym UNION ALL
    SELECT query_id, {pieces('sym')}, 2e0 FROM w_sym UNION ALL
    SELECT query_id, e, 2e0 FROM w_exc UNION ALL
    SELECT query_id, {pieces('e')}, 2e0 FROM w_exc),
  weights AS MATERIALIZED (SELECT query_id, term, sum(w * CASE WHEN term IN ({words(X.LOW_SIGNAL_TERMS)}) THEN 0.35e0 ELSE 1e0 END) AS weight
    FROM (SELECT query_id, lower(t) AS term, w FROM w_all) WHERE length(term) >= 3 AND term NOT IN ({QUERY_STOP}) GROUP BY ALL)"""


S["keyword_weights"] = with_parts("", "issues").rstrip() + "," + weights("issues") + " SELECT query_id, term, round(weight, 6) AS weight FROM weights"
S["conversation_weights"] = ("WITH conv AS (SELECT conv_id || ':' || turn AS query_id, text FROM conversations)," + weights("conv")
    + " SELECT query_id, term, round(weight, 6) AS weight FROM weights")
S["title_body_split"] = f"SELECT doc_id, {TITLE} AS title, CAST(length(text) AS INTEGER) AS body_length FROM documents"
S["document_literals"] = with_parts("SELECT literal, count(*) AS files FROM literals GROUP BY literal", "literals")
URL = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
S["url_path_functions"] = f"""
  SELECT page_id, {MODULE} AS module, {STEM} AS stem, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, split_part(path, '/', 1) AS top FROM {URL}"""
NORMAL = "regexp_replace(trim(path, ' '), '^[./]+|[./]+$', '', 'g')"
S["path_predicates"] = with_parts(f"""
  SELECT doc, regexp_matches(path, '{P.INDEX_TEST_PATH}') AS test_index, regexp_matches(lower(path), '{P.LOCALIZER_TEST_PATH}') AS test_localizer,
    regexp_matches(lower({NORMAL}), '{P.PRIOR_TEST_PATH}') AS test_prior, regexp_matches(lower({NORMAL}), '{P.PENALTY_TEST_PATH}') AS test_penalty,
    regexp_matches(lower(path), '{P.GENERATED_PATH}') AS generated, 'python' AS language, 'python' AS diff_language FROM corpus""", "corpus")
S["test_to_source"] = with_parts("""
  SELECT doc, 'pkg/' || doc || '.py,' || doc || '.py' AS nested,
    CASE WHEN contains(path, '/test_doc_') THEN 'doc_' || doc || '.py' ELSE '' END AS own FROM corpus""", "corpus")
S["ticket_id_extract"] = r"""
  SELECT o_orderkey, CAST(nullif(regexp_extract(CASE o_orderstatus WHEN 'F' THEN 'Ticket #' || o_orderkey || ' closed'
    WHEN 'O' THEN 'see issue ' || o_orderkey || ': ' || o_orderpriority ELSE 'order ' || o_orderkey END,
    '(?i)(?:ticket|issue|PR)\s*#?\s*(\d+)', 1), '') AS BIGINT) AS ticket_id FROM orders"""
S["commit_classify"] = """
  SELECT event_id, CASE event_type WHEN 'error' THEN 'avoid' WHEN 'click' THEN 'failed' WHEN 'view' THEN 'pattern'
    WHEN 'signup' THEN 'decision' ELSE 'noise' END AS classification FROM events"""
S["traceback_frames"] = """
  SELECT event_id, 0 AS pos, 'src/m' || user_id || '.py' AS path, 'run_' || event_type AS func FROM events UNION ALL
  SELECT event_id, 1, 'lib/base.py', 'call' FROM events UNION ALL
  SELECT event_id, 2, 'lib/u' || user_id || '.js', '' FROM events"""

SETS = f"""
  tokens AS MATERIALIZED ({set_tokens('documents', 'doc_id', 'text')}),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
  sim AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b, any_value(c) / (x.n + y.n - any_value(c))::DOUBLE AS s FROM (
      SELECT t.doc_id AS l, u.doc_id AS r, count(*) AS c FROM tokens t JOIN tokens u USING (term) WHERE t.doc_id <> u.doc_id GROUP BY ALL)
    JOIN documents a ON a.doc_id = l JOIN documents b ON b.doc_id = r JOIN sizes x ON x.doc_id = l JOIN sizes y ON y.doc_id = r
    GROUP BY a.doc_id, b.doc_id, x.n, y.n)"""
S["superseded"] = f"""WITH {SETS}
  SELECT a AS old_id, min(b) AS new_id, round(arg_min(s, b), 3) AS similarity FROM sim
  JOIN documents d ON d.doc_id = a JOIN documents e ON e.doc_id = b
  WHERE b > a AND s >= 0.35 AND d.lang = e.lang GROUP BY a"""
S["similar_documents"] = f"""WITH {SETS}
  SELECT a AS doc_id, b AS other, similarity, rank FROM (
    SELECT a, b, round(s, 3) AS similarity, row_number() OVER (PARTITION BY a ORDER BY round(s, 3) DESC, b DESC) AS rank
    FROM sim WHERE s >= 0.2) WHERE rank <= 5"""

S["longest_prefix_lookup"] = f"""
  WITH names AS (SELECT DISTINCT {MODULE} AS name FROM {URL}), mods AS (SELECT DISTINCT regexp_replace(name, '[.][^.]*$', '') AS m FROM names)
  SELECT name, arg_max(m, length(m)) AS resolved FROM names JOIN mods ON name = m OR starts_with(name, m || '.') GROUP BY name"""
S["suffix_lookup"] = with_parts("SELECT 'site-packages/x/' || path AS mention, path AS resolved FROM corpus", "corpus")
S["first_match_lookup"] = """
  SELECT doc_id, lang, arg_min(quality, d.doc_id - l.lid) AS resolved FROM documents d
  JOIN (SELECT doc_id AS lid, quality FROM labels) l ON l.lid BETWEEN d.doc_id - 2 AND d.doc_id GROUP BY ALL"""
S["anti_changed"] = "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
S["semi_split"] = """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderstatus"""
S["first_per_instance"] = "SELECT min(doc_id) AS doc_id, md5(text) AS instance, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)"
S["gold_language"] = with_parts("""
  SELECT query_id, arg_min(lang, (-n, lang)) AS lang FROM (
    SELECT query_id, lang, count(*) AS n FROM gold JOIN documents ON doc = doc_id GROUP BY ALL) GROUP BY query_id""", "gold")
S["compact_texts"] = """
  SELECT doc_id, md5(CASE WHEN length(text) <= 240 THEN text
    ELSE left(text, 141) || chr(10) || '... evidence compacted ...' || chr(10) || right(text, 71) END) AS digest FROM documents"""

HITS = """
  best AS MATERIALIZED (SELECT query_id, doc, string_split_regex(text, '\\r?\\n') AS lines FROM bm25_top JOIN corpus USING (doc)),
  win AS (SELECT query_id, doc, unnest(range(0, greatest(len(lines) - 12, 0) + 1, 6)) AS start FROM best),
  numbered AS (SELECT query_id, doc, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM best),
  hit AS (SELECT DISTINCT t.query_id, t.doc, t.no, t.term FROM (TERMS) t JOIN q_trm q ON q.query_id = t.query_id AND q.term = t.term),
  hits AS MATERIALIZED (SELECT w.query_id, w.doc, CAST(w.start AS INTEGER) AS start, count(DISTINCT term) AS hits FROM win w
    LEFT JOIN hit h ON h.query_id = w.query_id AND h.doc = w.doc AND h.no >= w.start AND h.no < w.start + 12 GROUP BY ALL)
""".replace("TERMS", code_terms("numbered", "query_id, doc, no", "line"))
S["evidence_window_hits"] = with_parts("", "bm25_top", "corpus", "q_trm").rstrip() + f",{HITS} SELECT query_id, doc, start, hits FROM hits"
# Greedy choice unrolled: four rounds, each taking the best window that overlaps none taken.
ROUND = """
  p{i} AS MATERIALIZED (SELECT query_id, doc, arg_max(start, (hits, start)) AS start FROM hits h
    WHERE NOT EXISTS (SELECT 1 FROM ({prev}) t WHERE t.query_id = h.query_id AND t.doc = h.doc AND abs(t.start - h.start) < 12) GROUP BY ALL)"""
ROUNDS, _taken = [], "SELECT query_id, doc, start FROM hits WHERE false"
for _i in range(1, 5):
    ROUNDS.append(ROUND.format(i=_i, prev=_taken))
    _taken += f" UNION ALL SELECT query_id, doc, start FROM p{_i}"
S["evidence_windows"] = with_parts("", "bm25_top", "corpus", "q_trm").rstrip() + f""",{HITS},{','.join(ROUNDS)}
  SELECT query_id, doc, string_agg(start, ',' ORDER BY start) AS starts FROM ({_taken}) GROUP BY ALL"""
S["evidence_outline"] = with_parts("""
  SELECT query_id, doc, string_agg(kind || ' ' || symbol || CASE WHEN said THEN '*' ELSE '' END, '; ' ORDER BY r) AS outline FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY said DESC, symbol) AS r FROM (
      SELECT b.query_id, b.doc, symbol, kind, i.ident IS NOT NULL AS said FROM bm25_top b JOIN defs USING (doc)
      LEFT JOIN q_ident i ON i.query_id = b.query_id AND i.ident = symbol)) WHERE r <= 40 GROUP BY ALL""", "bm25_top", "defs", "q_ident")

STATEMENTS = S
