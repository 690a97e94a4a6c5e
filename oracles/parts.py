"""Shared common table expressions, composed by name."""

from __future__ import annotations

import re

from lodestar.functions import paths as P
from lodestar.functions import text as X


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SIM_STOP = words(X.SIMILARITY_STOPWORDS)
CODE_STOP = words(X.CODE_STOPWORDS)
QUERY_STOP = words(X.QUERY_STOPWORDS)


def camel(expr: str, first: str = "a-z") -> str:
    """Camel boundaries as two passes, because RE2 has no look-behind."""
    inner = f"regexp_replace({expr}, '([{first}])([A-Z])', '\\1_\\2', 'g')"
    return f"regexp_replace({inner}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')"


def code_tokens(source: str, keys: str, text: str) -> str:
    return f"""
      SELECT {keys}, lower(t) AS term FROM (
        SELECT {keys}, unnest(string_split_regex({camel(text)}, '[^A-Za-z0-9]+')) AS t FROM {source})
      WHERE length(t) >= 3 AND lower(t) NOT IN ({SIM_STOP})"""


def code_terms(source: str, keys: str, text: str) -> str:
    marked = camel("ident", "a-z0-9")
    return f"""
      SELECT {keys}, lower(ident) AS term FROM (
        SELECT {keys}, ident, string_split_regex(regexp_replace({marked}, '^_+|_+$', '', 'g'), '_+') AS parts
        FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM {source}))
      WHERE len(parts) > 1 AND length(ident) >= 3
      UNION ALL
      SELECT {keys}, lower(p) AS term FROM (
        SELECT {keys}, unnest(string_split_regex(regexp_replace({marked}, '^_+|_+$', '', 'g'), '_+')) AS p
        FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')) AS ident FROM {source}))
      WHERE length(p) >= 2 AND lower(p) NOT IN ({CODE_STOP}) AND NOT regexp_full_match(p, '[0-9]+')"""


def set_tokens(source: str, keys: str, text: str, stop: str = SIM_STOP, pattern: str = X.SET_TOKEN) -> str:
    return f"""
      SELECT DISTINCT {keys}, t AS term FROM (
        SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{pattern}')) AS t FROM {source})
      WHERE t NOT IN ({stop})"""


def idf(n: str, df: str = "df") -> str:
    return f"ln(({n} - {df} + 0.5e0) / ({df} + 0.5e0) + 1e0)"


TITLE = r"left(regexp_extract(text, '^\s*([^\r\n]*?)[ \t]*(?:[\r\n]|$)', 1), 240)"
STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^./]*$', '')"
MODULE = r"replace(regexp_replace(regexp_replace(path, '\.[^./]*$', ''), '/(__init__|index)$', ''), '/', '.')"
LINE_START = r"(?:^|\n)([A-Za-z][A-Za-z0-9_]{2,})"
SUBJECT = """CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: urgent order' WHEN '2-HIGH' THEN 'feat: order'
  WHEN '3-MEDIUM' THEN 'refactor: order' WHEN '4-NOT SPECIFIED' THEN 'revert: order' ELSE 'docs: order' END
  || ' for customer ' || o_custkey"""
PART_PATH = "'b' || (l_suppkey % 5) || '/p' || l_partkey"

# name -> (needed names, body)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": ((), """
      SELECT doc_id AS doc, text, lang || '/' || CASE source WHEN 'src7' THEN 'build' ELSE source END || '/' ||
        CASE source WHEN 'src3' THEN 'test_doc_' ELSE 'doc_' END || doc_id || '.py' AS path,
        length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents"""),
    "issues": ((), f"SELECT item_id AS query_id, {TITLE} AS title, text FROM benchmark"),
    "gold": (("issues",), """
      SELECT query_id, doc_id AS doc FROM issues JOIN documents ON contains(documents.text, issues.text)"""),
    # token index
    "tok": ((), code_tokens("documents", "doc_id", "text")),
    "tok_post": (("tok",), "SELECT doc_id AS doc, term, count(*) AS tf FROM tok GROUP BY ALL"),
    "tok_doc": (("tok_post",), "SELECT doc, sum(tf) AS dl FROM tok_post GROUP BY doc"),
    "tok_stats": (("tok_doc",), "SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM tok_doc"),
    "tok_df": (("tok_post",), "SELECT term, count(*) AS df FROM tok_post GROUP BY term"),
    "q_tok": (("issues",), "SELECT query_id, term, count(*) AS qtf FROM (" + code_tokens("issues", "query_id", "text") + ") GROUP BY ALL"),
    "bm25_contrib": (("q_tok", "tok_post", "tok_df", "tok_doc", "tok_stats"), f"""
      SELECT query_id, doc, term,
        (qtf * {idf('n')}) * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * (dl / avgdl)))) AS c
      FROM q_tok JOIN tok_df USING (term) JOIN tok_post USING (term) JOIN tok_doc USING (doc), tok_stats"""),
    "bm25_scores": (("bm25_contrib",), "SELECT query_id, doc, round(sum(c), 6) AS score FROM bm25_contrib GROUP BY ALL"),
    "bm25_top": (("bm25_scores",), """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank
      FROM bm25_scores) WHERE rank <= 10"""),
    # term index and issue terms
    "trm": ((), code_terms("documents", "doc_id", "text")),
    "trm_post": (("trm",), "SELECT doc_id AS doc, term, count(*) AS tf FROM trm GROUP BY ALL"),
    "trm_doc": (("trm_post",), "SELECT doc, sum(tf) AS dl FROM trm_post GROUP BY doc"),
    "trm_stats": (("trm_doc",), "SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM trm_doc"),
    "trm_df": (("trm_post",), "SELECT term, count(*) AS df FROM trm_post GROUP BY term"),
    "q_body": (("issues",), "SELECT query_id, term, count(*) AS qtf FROM (" + code_terms("issues", "query_id", "text") + ") GROUP BY ALL"),
    "q_title": (("issues",), "SELECT DISTINCT query_id, term FROM (" + code_terms("issues", "query_id", "title") + ")"),
    "q_trm": (("q_body", "q_title"), """
      SELECT b.query_id, b.term, b.qtf, 1e0 + ln(b.qtf) AS lw, t.term IS NOT NULL AS in_title
      FROM q_body b LEFT JOIN q_title t ON b.query_id = t.query_id AND b.term = t.term"""),
    "ch_bm25_rows": (("q_trm", "trm_post", "trm_df", "trm_doc", "trm_stats"), f"""
      SELECT query_id, doc, in_title,
        lw * CASE WHEN in_title THEN 1.5e0 ELSE 1e0 END * {idf('n')}
        * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * (dl / avgdl)))) AS c
      FROM q_trm JOIN trm_df USING (term) JOIN trm_post USING (term) JOIN trm_doc USING (doc), trm_stats"""),
    "ch_bm25": (("ch_bm25_rows",), "SELECT query_id, doc, sum(c) AS value FROM ch_bm25_rows GROUP BY ALL"),
    "ch_bm25_title": (("ch_bm25_rows",), "SELECT query_id, doc, sum(c) AS value FROM ch_bm25_rows WHERE in_title GROUP BY ALL"),
    "path_terms": (("corpus",), "SELECT DISTINCT doc, term FROM (" + code_terms(
        f"(SELECT doc, replace({MODULE}, '.', ' ') AS m FROM corpus)", "doc", "m") + ")"),
    "ch_path": (("path_terms", "q_trm", "trm_stats"), """
      SELECT query_id, doc, sum(ln(1e0 + n / df) * lw) AS value
      FROM path_terms JOIN (SELECT term, count(*)::DOUBLE AS df FROM path_terms GROUP BY term) USING (term)
      JOIN q_trm USING (term), trm_stats GROUP BY ALL"""),
    "defs": (("corpus",), f"""
      SELECT doc, lower(w) AS symbol, min(CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'class' ELSE 'func' END) AS kind
      FROM (SELECT doc, unnest(regexp_extract_all(text, '{LINE_START}', 1)) AS w FROM corpus) GROUP BY ALL"""),
    "def_terms": (("defs",), "SELECT DISTINCT doc, term FROM (" + code_terms("defs", "doc", "symbol") + ")"),
    "ch_api": (("def_terms", "defs", "q_trm", "trm_stats"), f"""
      SELECT query_id, doc, sum(w) / sqrt(1e0 + n_defs / 20e0) AS value FROM (
        SELECT query_id, doc, {idf('n')} * lw AS w
        FROM def_terms JOIN (SELECT term, count(*) AS df FROM def_terms GROUP BY term) USING (term)
        JOIN q_trm USING (term), trm_stats WHERE df < n / 2e0)
      JOIN (SELECT doc, count(*) AS n_defs FROM defs GROUP BY doc) USING (doc) GROUP BY query_id, doc, n_defs"""),
    "q_ident": (("issues",), """
      SELECT query_id, lower(i) AS ident, count(*) AS cnt FROM (
        SELECT query_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS i FROM issues)
      WHERE length(i) >= 3 GROUP BY ALL"""),
    "def_hits": (("defs", "q_ident", "trm_stats"), """
      SELECT query_id, doc, kind, ln(1e0 + n / paths) * (1e0 + ln(cnt)) AS w
      FROM q_ident JOIN defs ON ident = symbol
      JOIN (SELECT symbol, count(*)::DOUBLE AS paths FROM defs GROUP BY symbol) s ON s.symbol = ident, trm_stats"""),
    "ch_defs": (("def_hits",), "SELECT query_id, doc, sum(w) AS value FROM def_hits GROUP BY ALL"),
    "ch_defs_class": (("def_hits",), "SELECT query_id, doc, sum(w) AS value FROM def_hits WHERE kind = 'class' GROUP BY ALL"),
    "lit_lines": (("corpus",), r"""
      SELECT doc, v, unnest(string_split_regex(v, '%[-#0 +]*\d*(?:\.\d+)?[sdrfi]|\{[^{}]*\}')) AS f
      FROM (SELECT doc, regexp_replace(line, '^\s+|\s+$', '', 'g') AS v FROM (
        SELECT doc, unnest(string_split(text, chr(10))) AS line FROM corpus))
      WHERE length(v) BETWEEN 12 AND 300"""),
    "literals": (("lit_lines",), """
      SELECT DISTINCT doc, literal FROM (
        SELECT doc, v, lower(trim(arg_max(f, length(f)), ' ')) AS literal FROM lit_lines GROUP BY doc, v)
      WHERE length(literal) >= 12 AND contains(literal, ' ')"""),
    "said": (("issues",), r"SELECT query_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS said FROM issues"),
    "lit_in": (("literals", "said"), """
      SELECT query_id, literal FROM (SELECT DISTINCT literal FROM literals) JOIN said ON contains(said, literal)"""),
    "ch_literal": (("lit_in", "literals", "trm_stats"), """
      SELECT query_id, doc, sum(ln(1e0 + n / paths) * least(length(literal), 80) / 40e0) AS value
      FROM lit_in JOIN (SELECT literal, count(*)::DOUBLE AS paths FROM literals GROUP BY literal) USING (literal)
      JOIN literals USING (literal), trm_stats GROUP BY query_id, doc"""),
    "channels": (("ch_bm25", "ch_bm25_title", "ch_path", "ch_api", "ch_defs", "ch_defs_class", "ch_literal"), """
      SELECT query_id, doc, 'bm25' AS channel, round(value, 6) AS value FROM ch_bm25 UNION ALL
      SELECT query_id, doc, 'bm25_title', round(value, 6) FROM ch_bm25_title UNION ALL
      SELECT query_id, doc, 'path_bm25', round(value, 6) FROM ch_path UNION ALL
      SELECT query_id, doc, 'api', round(value, 6) FROM ch_api UNION ALL
      SELECT query_id, doc, 'defs', round(value, 6) FROM ch_defs UNION ALL
      SELECT query_id, doc, 'defs_class', round(value, 6) FROM ch_defs_class UNION ALL
      SELECT query_id, doc, 'literal', round(value, 6) FROM ch_literal"""),
    "feat": (("channels",), """
      SELECT query_id, channel, doc, value, value / max(value) OVER (PARTITION BY query_id, channel) AS n,
        row_number() OVER (PARTITION BY query_id, channel ORDER BY value DESC, doc) AS rank
      FROM channels WHERE value > 0"""),
    # commits
    "commits": ((), f"""
      SELECT o_orderkey AS commit, {SUBJECT} AS subject, o_orderdate AS at, 'dev' || (o_custkey % 20) AS author,
        row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS age FROM orders"""),
    "changes": ((), "SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem"),
    "sized": (("changes", "commits"), """
      SELECT commit, file, age, count(*) OVER (PARTITION BY commit) AS n FROM changes JOIN commits USING (commit)"""),
    "pairs": (("sized",), """
      SELECT a.file AS "left", b.file AS "right", round(sum(pow(2e0, -a.age / 150e0) / (a.n - 1)), 8) AS weight
      FROM sized a JOIN sized b USING (commit) WHERE a.file < b.file AND a.n BETWEEN 2 AND 20 GROUP BY ALL"""),
    "two": (("changes",), """
      SELECT DISTINCT "left", "right" FROM (
        SELECT commit, min(file) AS "left", max(file) AS "right" FROM changes GROUP BY commit) WHERE "right" > "left" """),
    "sparse": (("two",), """
      SELECT "left" AS src, "right" AS dst FROM two UNION ALL SELECT "right", "left" FROM two"""),
    "history": (("commits", "changes"), r"""
      SELECT file AS doc, count(*) AS touches, count(*) FILTER (age < 300) AS recent,
        count(*) FILTER (regexp_matches(subject, '(?i)\b(fix|fixed|fixes|bug|regression|refs?\s+#|closes?\s+#)')) AS fixes
      FROM changes JOIN commits USING (commit) GROUP BY file"""),
    # events and state
    "calls": ((), r"""
      SELECT event_id AS seq, ts, event_type AS tool, value AS duration_ms, k AS output_size,
        CASE WHEN k % 10 = 0 THEN 'TimeoutError' WHEN k % 10 = 5 THEN 'ValueError' END AS error,
        'user ' || user_id || ' size ' || k AS msg
      FROM (SELECT *, CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT) AS k FROM events)"""),
    "preds": ((), """
      SELECT l_orderkey * 2 + v AS id, l_orderkey AS ticket_id, v, 'p' || l_partkey AS file
      FROM lineitem, (SELECT unnest([0, 1]) AS v) WHERE (v = 0 OR l_orderkey % 2 = 0) AND (v = 0 OR l_linenumber <= 4)"""),
    "outs": ((), """
      SELECT o_orderkey AS id, o_orderkey AS ticket_id, o_custkey, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'reverted' ELSE 'abandoned' END AS outcome FROM orders"""),
    "actual": ((), "SELECT DISTINCT l_orderkey AS ticket_id, 'p' || l_partkey AS file FROM lineitem WHERE l_quantity > 20"),
    "pred_pr": (("preds", "actual", "outs"), """
      SELECT p.id, p.ticket_id, p.np, coalesce(a.na, 0) AS na, coalesce(h.tp, 0) AS tp,
        CAST(round(coalesce(h.tp, 0) / p.np::DOUBLE, 3) AS DOUBLE) AS prec,
        CAST(round(coalesce(coalesce(h.tp, 0) / nullif(a.na, 0)::DOUBLE, 0), 3) AS DOUBLE) AS rec
      FROM (SELECT id, ticket_id, count(DISTINCT file) AS np FROM preds GROUP BY ALL) p
      LEFT JOIN (SELECT ticket_id, count(*) AS na FROM actual GROUP BY ALL) a USING (ticket_id)
      LEFT JOIN (SELECT id, count(DISTINCT file) AS tp FROM preds JOIN actual USING (ticket_id, file) GROUP BY ALL) h USING (id)"""),
    "reconciled": (("outs", "pred_pr"), """
      SELECT o.id, o.ticket_id, o.o_custkey, o.outcome, p.prec, p.rec, p.np, p.na, p.tp,
        CASE WHEN p.id IS NULL OR o.outcome = 'abandoned' THEN 'skipped' ELSE 'reconciled' END AS status,
        CASE WHEN p.id IS NULL OR o.outcome = 'abandoned' THEN NULL
          WHEN o.outcome = 'completed' AND p.prec >= 0.3 THEN 'hit' ELSE 'miss' END AS feedback
      FROM outs o LEFT JOIN (SELECT * FROM pred_pr QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY id DESC) = 1) p
      USING (ticket_id)"""),
    "messages": (("commits",), f"""
      SELECT commit, subject AS message, files, n FROM commits JOIN (
        SELECT l_orderkey AS commit, list(DISTINCT {PART_PATH}) AS files, count(DISTINCT {PART_PATH}) AS n
        FROM lineitem GROUP BY 1) USING (commit)"""),
}


def with_parts(final: str, *needs: str) -> str:
    """``final`` preceded by the named expressions and all they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][1]})" for name in ordered)
    body = re.sub(r"^\s+", "", final)
    return f"WITH {ctes}\n{body}" if ctes else body
