"""Statements for indexes, retrieval, channels, fusion and metrics."""

from __future__ import annotations

from lodestar.functions import paths as P
from lodestar.operators.fusion import DEFAULT_WEIGHTS

from .parts import LINE_START, STEM, code_tokens, idf, with_parts, words

S: dict[str, str] = {}

S["term_stats"] = with_parts("SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tok_post GROUP BY term", "tok_post")
S["idf_table"] = with_parts(f"SELECT term, df, round({idf('n')}, 6) AS idf FROM tok_df, tok_stats", "tok_df", "tok_stats")
S["doc_lengths"] = with_parts(
    "SELECT doc, CAST(dl AS BIGINT) AS dl, round(dl / avgdl, 6) AS relative FROM tok_doc, tok_stats", "tok_stats")
S["boosted_terms"] = with_parts(f"""
  SELECT path, term, CAST(tf AS BIGINT) AS tf, CAST(sum(tf) OVER (PARTITION BY path) AS BIGINT) AS dl FROM (
    SELECT path, term, sum(weight) AS tf FROM ({code_tokens('''(
        SELECT path, STEM AS t, 5 AS weight FROM corpus UNION ALL
        SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1), 2 FROM corpus UNION ALL
        SELECT path, s, 3 FROM (SELECT path, unnest(regexp_extract_all(text, 'LINE_START', 1)) AS s FROM corpus) UNION ALL
        SELECT path, text, 1 FROM corpus)'''.replace('STEM', STEM).replace('LINE_START', LINE_START), 'path, weight', 't')})
    GROUP BY path, term)""", "corpus")

LEGACY = r"""
  legacy AS MATERIALIZED (
    SELECT path, term, max(w) AS w FROM (
      SELECT path, lower(s) AS term, 3 AS w FROM (SELECT path, unnest(regexp_extract_all(text, 'LINE_START', 1)) AS s FROM corpus)
      UNION ALL
      SELECT path, lower(i), 1 FROM (SELECT path, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]{3,}')) AS i FROM corpus))
    GROUP BY path, term),
  legacy_doc AS MATERIALIZED (SELECT path, sum(w) AS dl FROM legacy GROUP BY path),
  legacy_stats AS MATERIALIZED (
    SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(dl) FROM legacy_doc)::DOUBLE / (SELECT count(*) FROM corpus) AS avgdl),
  legacy_df AS MATERIALIZED (SELECT term, count(*) AS df FROM legacy GROUP BY term)""".replace("LINE_START", LINE_START)


def with_legacy(final: str, *needs: str) -> str:
    head = with_parts("", "corpus", *needs).rstrip()
    return f"{head},{LEGACY}\n{final}"


S["legacy_stats"] = with_legacy("SELECT term, df, n, round(avgdl, 6) AS avgdl FROM legacy_df, legacy_stats")
S["bm25_topk"] = with_parts("SELECT query_id, doc, score, rank FROM bm25_top", "bm25_top")
S["bm25_explain"] = with_parts("""
  SELECT b.query_id, b.doc, b.score, b.rank, m.matched_terms FROM bm25_top b JOIN (
    SELECT query_id, doc, string_agg(term, ',' ORDER BY r) AS matched_terms FROM (
      SELECT query_id, doc, term, row_number() OVER (PARTITION BY query_id, doc ORDER BY round(c, 6) DESC, term) AS r
      FROM bm25_contrib) WHERE r <= 3 GROUP BY ALL) m USING (query_id, doc)""", "bm25_top")
S["bm25_test_penalty"] = with_parts(f"""
  SELECT query_id, doc, score, rank FROM (
    SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM (
      SELECT query_id, doc, round(CASE WHEN regexp_matches(path, '{P.INDEX_TEST_PATH}') THEN s * 0.3e0 ELSE s END, 6) AS score
      FROM (SELECT query_id, doc, sum(c) AS s FROM bm25_contrib GROUP BY ALL) JOIN corpus USING (doc)))
  WHERE rank <= 10""", "bm25_contrib", "corpus")


def top(channel: str, k: int = 20) -> str:
    return with_parts(f"""
      SELECT query_id, doc, value, rank FROM (
        SELECT query_id, doc, value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, doc) AS rank
        FROM (SELECT query_id, doc, round(value, 6) AS value FROM {channel})) WHERE rank <= {k}""", channel)


REPORTS = """WITH reports AS (
  SELECT event_id AS query_id, event_id % n AS a, (event_id * 7 + 1) % n AS b FROM events, (SELECT count(*) AS n FROM documents))
SELECT query_id, doc, {value} AS value FROM ({rows}) GROUP BY query_id, doc"""
S["traceback_channel"] = REPORTS.format(
    value="max(v)", rows="SELECT query_id, b AS doc, 1e0 AS v FROM reports UNION ALL SELECT query_id, a, 0.5e0 FROM reports")
S["literal_path_channel"] = REPORTS.format(
    value="sum(v)", rows="SELECT query_id, b AS doc, 1e0 AS v FROM reports UNION ALL SELECT query_id, a, 2e0 FROM reports")
S["module_channel"] = REPORTS.format(value="sum(v)", rows="SELECT query_id, b AS doc, 1e0 AS v FROM reports")
S["bm25_title_weighted"] = top("ch_bm25")
S["bm25_title_only"] = top("ch_bm25_title")
S["api_bm25"] = top("ch_api")
S["path_bm25"] = with_parts("SELECT query_id, doc, round(value, 6) AS value FROM ch_path", "ch_path")
S["definition_channel"] = with_parts("""
  SELECT query_id, doc, 'defs' AS channel, round(value, 6) AS value FROM ch_defs UNION ALL
  SELECT query_id, doc, 'defs_class', round(value, 6) FROM ch_defs_class""", "ch_defs", "ch_defs_class")
S["literal_channel"] = with_parts("SELECT query_id, doc, round(value, 6) AS value FROM ch_literal", "ch_literal")
S["channel_normalise"] = with_parts("""
  SELECT query_id, channel, doc, value, round(n, 6) AS n, round(1e0 / rank, 6) AS rr FROM feat""", "feat")

DIRECT = ("bm25", "bm25_title", "path_bm25", "api", "defs", "defs_class", "literal")
WIDE_COLUMNS = ", ".join(
    f"coalesce(max(n) FILTER (channel = '{c}'), 0e0) AS {c}_n, coalesce(max(1e0 / rank) FILTER (channel = '{c}'), 0e0) AS {c}_rr"
    for c in DIRECT)
WIDE = f"SELECT query_id, doc, {WIDE_COLUMNS}, max(1e0 / rank) AS best_rr FROM feat GROUP BY ALL"
POOL = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best_rr DESC, doc) AS pool_rank
  FROM wide JOIN (SELECT doc, path, n_lines FROM corpus WHERE NOT regexp_matches(lower(path), '{P.LOCALIZER_TEST_PATH}')
    AND NOT regexp_matches(lower(path), '{P.GENERATED_PATH}')) USING (doc)) WHERE pool_rank <= 300"""
S["channel_pivot"] = with_parts(
    "SELECT query_id, doc, " + ", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in DIRECT for s in ("n", "rr"))
    + f" FROM ({WIDE})", "feat")
S["candidate_pool"] = with_parts(
    f", wide AS ({WIDE}), pool AS ({POOL}) SELECT query_id, doc, round(best_rr, 6) AS best_rr, pool_rank FROM pool",
    "feat", "corpus")

NEIGHBOUR = """
  edges AS (SELECT src, dst FROM sparse WHERE src < dst AND src IN (SELECT doc FROM corpus) AND dst IN (SELECT doc FROM corpus)),
  nb_raw AS (
    SELECT query_id, o AS doc, round(max(n * f), 6) AS value FROM feat JOIN (
      SELECT src AS doc, dst AS o, 1e0 AS f FROM edges UNION ALL SELECT dst, src, 0.5e0 FROM edges) USING (doc)
    WHERE channel = 'bm25' GROUP BY query_id, o),
  nb AS MATERIALIZED (
    SELECT query_id, doc, value, n, rank FROM (
      SELECT *, value / max(value) OVER (PARTITION BY query_id) AS n,
        row_number() OVER (PARTITION BY query_id ORDER BY value DESC, doc) AS rank FROM nb_raw WHERE value > 0) r)"""
S["neighbour_propagation"] = with_parts("", "feat", "corpus", "sparse").rstrip() + f""",{NEIGHBOUR}
  SELECT query_id, doc, value, round(1e0 / rank, 6) AS rr FROM nb"""

STRUCTURAL = f"""
  CASE WHEN {STEM} IN ('__init__', 'index') THEN 1e0 ELSE 0e0 END AS is_init,
  CASE WHEN {STEM} IN ({words(P.GENERIC_STEMS)}) THEN 1e0 ELSE 0e0 END AS is_generic,
  CASE WHEN lower(split_part(path, '/', 1)) IN ({words(P.NON_PACKAGE_DIRS)}) THEN 1e0 ELSE 0e0 END AS non_package,
  CAST(length(path) - length(replace(path, '/', '')) AS DOUBLE) AS depth"""
S["structural_features"] = with_parts(f"""
  SELECT query_id, doc, path, {STRUCTURAL}, round(ln(1e0 + n_lines), 6) AS log_lines,
    CASE WHEN EXISTS (SELECT 1 FROM q_ident i WHERE i.query_id = b.query_id AND i.ident = lower({STEM})) THEN 1e0 ELSE 0e0 END AS stem_in_issue
  FROM bm25_top b JOIN corpus USING (doc)""", "bm25_top", "corpus", "q_ident")
S["history_counters"] = with_parts("SELECT doc, touches, recent, fixes FROM history", "history")

SAID_STEM = f"""CASE WHEN EXISTS (SELECT 1 FROM q_ident i WHERE i.query_id = p.query_id AND i.ident = lower({STEM}))
  OR EXISTS (SELECT 1 FROM q_trm t WHERE t.query_id = p.query_id AND t.term = lower({STEM})) THEN 1e0 ELSE 0e0 END"""


def ranked_scores(expression: str, extra_ctes: str = "", wide: str = WIDE, k: int = 20, cols: str = "query_id, doc, score, rank",
                  joins: str = "", needs: tuple[str, ...] = ()) -> str:
    head = with_parts("", "feat", "corpus", "q_ident", "q_trm", *needs).rstrip()
    return f"""{head}{extra_ctes}, wide AS MATERIALIZED ({wide}), pool AS MATERIALIZED ({POOL}),
      scored AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path DESC) AS rank FROM (
        SELECT *, round({expression}, 6) AS score FROM (
          SELECT p.*, {SAID_STEM} AS stem_in_issue, {STRUCTURAL} FROM pool p) {joins}))
      SELECT {cols} FROM scored WHERE rank <= {k}"""


def weighted(names: list[str]) -> str:
    return " + ".join(f"({DEFAULT_WEIGHTS[n]}e0) * {n}" for n in names)


BASE_NAMES = [n for n in DEFAULT_WEIGHTS if n.rsplit("_", 1)[0] in DIRECT or n in ("stem_in_issue", "is_init", "is_generic", "non_package")]
S["linear_score"] = ranked_scores(weighted(BASE_NAMES))
TREES = """
  (CASE WHEN bm25_n <= 0.5 THEN CASE WHEN bm25_title_n <= 0.25 THEN -0.5e0 ELSE 0.1e0 END
     ELSE CASE WHEN defs_n <= 0.1 THEN 0.75e0 ELSE 1.5e0 END END)
  + (CASE WHEN literal_n <= 0 THEN -0.25e0 ELSE CASE WHEN literal_n <= 0.5 THEN 0.5e0 ELSE 2e0 END END)
  + (CASE WHEN path_bm25_n <= 0.9 THEN 0e0 ELSE CASE WHEN depth <= 1 THEN 0.05e0 ELSE 0.15e0 END END)"""
S["tree_score"] = ranked_scores(TREES)
S["tree_score_batched"] = S["tree_score"]
NAMES = [f"{c}_{s}" for c in DIRECT for s in ("n", "rr")]
S["pairwise_differences"] = with_parts(f""", wide AS ({WIDE}), pool AS ({POOL}),
  lab AS MATERIALIZED (SELECT p.*, g.doc IS NOT NULL AS is_gold FROM pool p LEFT JOIN gold g USING (query_id, doc)),
  wrong AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY greatest({', '.join(NAMES)}) DESC, doc) AS r
    FROM lab WHERE NOT is_gold) WHERE r <= 60),
  pairs AS MATERIALIZED (SELECT {', '.join(f'a.{n} - b.{n} AS {n}' for n in NAMES)} FROM lab a JOIN wrong b USING (query_id) WHERE a.is_gold)
""" + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS pairs, round(avg({n}), 6) AS mean, round(max(abs({n})), 6) AS largest FROM pairs" for n in NAMES),
  "feat", "corpus", "gold")

FULL_WIDE = f"""
  SELECT query_id, doc, {WIDE_COLUMNS}, coalesce(max(n) FILTER (channel = 'neighbor'), 0e0) AS neighbor_n,
    coalesce(max(1e0 / rank) FILTER (channel = 'neighbor'), 0e0) AS neighbor_rr, max(1e0 / rank) AS best_rr
  FROM (SELECT query_id, channel, doc, n, rank FROM feat UNION ALL SELECT query_id, 'neighbor', doc, n, rank FROM nb) GROUP BY query_id, doc"""
LABELS = (("literal", "contains quoted message"), ("defs", "defines issue symbol"), ("bm25_title", "matches title"),
          ("bm25", "matches issue text"), ("api", "API names match"), ("path_bm25", "path matches"),
          ("neighbor", "imports/imported by a match"))
WHY_LEAD = ", ".join(f"CASE WHEN {c}_rr = 1 THEN '{t}' END" for c, t in LABELS)
WHY_HALF = ", ".join(f"CASE WHEN {c}_n >= 0.5 AND {c}_rr <> 1 THEN '{t}' END" for c, t in LABELS)
WHY = f"""coalesce(nullif(array_to_string(list_filter([{WHY_LEAD}, {WHY_HALF}], lambda x: x IS NOT NULL)[1:3], ', '), ''),
  'weak lexical match')"""
FULL_EXPR = weighted(BASE_NAMES + ["neighbor_n"]) + " + 0.02e0 * ln(1e0 + coalesce(touches, 0)) + 0.02e0 * ln(1e0 + coalesce(fixes, 0))"
FULL = dict(extra_ctes="," + NEIGHBOUR, wide=FULL_WIDE, needs=("sparse", "history"), k=10,
            joins="LEFT JOIN (SELECT doc AS hdoc, touches, fixes FROM history) h ON h.hdoc = doc")
S["localize"] = ranked_scores(FULL_EXPR, cols=f"query_id, rank, doc, path, score, {WHY} AS why", **FULL)


def tiers(results: str, target: str, pooled: str = "false") -> str:
    """Tier rows from a results relation (query_id, margin, gold_rank)."""
    hits = ", ".join(f"avg(CASE WHEN gold_rank <= {k} THEN 1e0 ELSE 0e0 END) AS h{k}" for k in range(1, 11))
    read = "CASE " + " ".join(f"WHEN h{k} >= {target} THEN {k}" for k in range(1, 11)) + " ELSE 10 END"
    rate = "CASE " + " ".join(f"WHEN h{k} >= {target} THEN h{k}" for k in range(1, 11)) + " ELSE h10 END"
    return f"""
      SELECT label, CASE WHEN last < n_all THEN round(low, 4) ELSE 0e0 END AS min_margin, {read} AS read_first,
        round({rate}, 3) AS expected_hit, round(h1, 3) AS hit_at_1, n FROM (
        SELECT label, min(margin) AS low, max(i) AS last, max(n_all) AS n_all, count(*) AS n, {hits} FROM (
          SELECT *, CASE WHEN {pooled} THEN 'low' WHEN i <= round_even(n_all * 0.3, 0) THEN 'high'
            WHEN i <= round_even(n_all * 0.7, 0) THEN 'medium' ELSE 'low' END AS label
          FROM (SELECT *, row_number() OVER (ORDER BY margin DESC, query_id) AS i, count(*) OVER () AS n_all FROM {results}))
        GROUP BY label)"""


RESULTS = """
  best AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM bm25_scores)
    WHERE rank <= 300),
  results AS MATERIALIZED (
    SELECT query_id, round(coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 0), 6) AS margin,
      min(rank) FILTER (g.doc IS NOT NULL) AS gold_rank, count(*) AS n
    FROM best b LEFT JOIN gold g USING (query_id, doc) GROUP BY query_id)"""


def with_results(final: str, *needs: str) -> str:
    return with_parts("", "bm25_scores", "gold", *needs).rstrip() + f",{RESULTS}{final}"


S["top2_margin"] = with_results(" SELECT query_id, CASE WHEN n > 1 THEN margin END AS margin, n FROM results")
S["tier_calibration"] = with_results(tiers("results", "0.5"))
PLAN = f""", tier AS MATERIALIZED ({tiers('results', '0.5')}),
  plan AS MATERIALIZED (
    SELECT query_id, arg_max(label, min_margin) AS confidence, CAST(arg_max(read_first, min_margin) AS INTEGER) AS read_first,
      arg_max(expected_hit, min_margin) AS expected_hit, round(any_value(margin), 4) AS margin
    FROM results JOIN tier ON margin >= min_margin GROUP BY query_id)"""
S["reading_plan"] = with_results(PLAN + " SELECT query_id, margin, confidence, read_first, expected_hit FROM plan")
S["holdout_check"] = with_results(f""",
  aged AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY query_id DESC) AS age, count(*) OVER () // 3 AS n_test FROM results),
  train AS MATERIALIZED (SELECT query_id, margin, gold_rank FROM aged WHERE age > n_test),
  split AS MATERIALIZED ({tiers('train', '0.5')}),
  pooled AS MATERIALIZED ({tiers('train', '0.5', 'true')}),
  disorder AS (SELECT count(*) > 0 AS bad FROM split a JOIN split b
    ON list_position(['high', 'medium', 'low'], a.label) < list_position(['high', 'medium', 'low'], b.label) AND a.read_first > b.read_first),
  used AS MATERIALIZED (SELECT split.* FROM split, disorder WHERE NOT bad UNION ALL SELECT pooled.* FROM pooled, disorder WHERE bad)
  SELECT count(*) AS n, round(avg(e), 3) AS claimed, round(avg(CASE WHEN gold_rank <= r THEN 1e0 ELSE 0e0 END), 3) AS observed,
    round(avg(r), 1) AS avg_files
  FROM (SELECT query_id, any_value(gold_rank) AS gold_rank, arg_max(u.expected_hit, u.min_margin) AS e, arg_max(u.read_first, u.min_margin) AS r
    FROM aged a JOIN used u ON a.margin >= u.min_margin WHERE a.age <= a.n_test GROUP BY query_id)""")

KS = (1, 3, 5, 10)
METRIC_COLUMNS = ", ".join(
    f"CAST(coalesce(max(ok) FILTER (rank <= {k}), 0) AS INTEGER) AS hit_{k}, "
    f"round(coalesce(sum(ok) FILTER (rank <= {k}), 0) / n_gold::DOUBLE, 6) AS recall_{k}, "
    f"round(coalesce(sum(found / rank::DOUBLE) FILTER (rank <= {k} AND ok = 1), 0) / least(n_gold, {k}), 6) AS ap_{k}" for k in KS)
METRICS = f"""
  per_query AS MATERIALIZED (
    SELECT query_id, n_gold, count(doc) AS n_predicted, {METRIC_COLUMNS}
    FROM (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id) LEFT JOIN (
      SELECT b.query_id, b.doc, b.rank, CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END AS ok,
        sum(CASE WHEN g.doc IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.query_id ORDER BY b.rank) AS found
      FROM bm25_top b LEFT JOIN gold g USING (query_id, doc)) USING (query_id) GROUP BY query_id, n_gold)"""


def with_metrics(final: str, *needs: str) -> str:
    return with_parts("", "bm25_top", "gold", *needs).rstrip() + f",{METRICS}{final}"


S["hit_recall_ap"] = with_metrics(" SELECT * FROM per_query")
S["metrics_summary"] = with_metrics(" SELECT count(*) AS instances, " + ", ".join(
    f"round(avg(hit_{k}), 6) AS hit_{k}, round(avg(recall_{k}), 6) AS recall_{k}, round(avg(ap_{k}), 6) AS map_{k}" for k in KS)
    + ", round(avg(n_gold), 6) AS avg_gold, round(avg(n_predicted), 6) AS avg_predicted FROM per_query")
LANG = """, by_lang AS MATERIALIZED (SELECT * FROM per_query JOIN (
  SELECT query_id, min(lang) AS lang FROM gold JOIN documents ON doc = doc_id GROUP BY query_id) USING (query_id))"""
S["micro_macro_worst"] = with_metrics(LANG + """
  SELECT round(sum(h1 * n) / sum(n), 4) AS micro_hit_1, round(sum(h10 * n) / sum(n), 4) AS micro_hit_10,
    round(avg(h1), 4) AS macro_hit_1, round(avg(h10), 4) AS macro_hit_10,
    (SELECT lang FROM (SELECT lang, avg(hit_1) AS a FROM by_lang GROUP BY lang) ORDER BY a, lang LIMIT 1) AS worst_group,
    round(min(h1), 4) AS worst_hit_1
  FROM (SELECT lang, count(*) AS n, avg(hit_1) AS h1, avg(hit_10) AS h10 FROM by_lang GROUP BY lang)""")
S["grouping_lang_tier"] = with_parts("", "bm25_top", "bm25_scores", "gold").rstrip() + f""",{METRICS}{LANG},{RESULTS}{PLAN}
  SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, confidence, count(*) AS n, round(avg(hit_10), 6) AS hit_rate
  FROM by_lang JOIN plan USING (query_id) GROUP BY GROUPING SETS ((lang, confidence), (confidence))"""
S["containment_join"] = with_parts("SELECT query_id, doc FROM gold", "gold")

S["localize_with_plan"] = ranked_scores(FULL_EXPR, cols="*", **{**FULL, "k": 1000000, "needs": ("sparse", "history", "gold")})
_head, _tail = S["localize_with_plan"].rsplit("SELECT * FROM scored", 1)
S["localize_with_plan"] = _head.rstrip() + f""", all_results AS MATERIALIZED (
    SELECT query_id, coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 0) AS margin,
      min(rank) FILTER (g.doc IS NOT NULL) AS gold_rank, count(*) AS n FROM scored LEFT JOIN gold g USING (query_id, doc) GROUP BY query_id),
  asked AS MATERIALIZED (SELECT query_id, coalesce(margin, 0) AS margin, gold_rank FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN all_results USING (query_id)),
  split AS MATERIALIZED ({tiers('asked', '0.85')}),
  pooled AS MATERIALIZED ({tiers('asked', '0.85', 'true')}),
  disorder AS (SELECT count(*) > 0 AS bad FROM split a JOIN split b
    ON list_position(['high', 'medium', 'low'], a.label) + 1 = list_position(['high', 'medium', 'low'], b.label) AND a.read_first > b.read_first),
  used AS MATERIALIZED (SELECT split.* FROM split, disorder WHERE NOT bad UNION ALL SELECT pooled.* FROM pooled, disorder WHERE bad),
  plan AS (SELECT query_id, arg_max(label, min_margin) AS c, arg_max(read_first, min_margin) AS r FROM all_results JOIN used ON margin >= min_margin GROUP BY query_id)
  SELECT query_id, rank, doc, score, CASE WHEN rank <= r THEN c ELSE 'low' END AS confidence FROM scored JOIN plan USING (query_id) WHERE rank <= 10"""

CENTRES = """
  flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  centre AS MATERIALIZED (SELECT label, i, avg(x) AS m FROM flat GROUP BY ALL)"""
S["cosine_rerank"] = f"""WITH {CENTRES}
  SELECT query_id, doc, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc) AS rank FROM (
      SELECT f.label AS query_id, vec_id AS doc,
        round(greatest(0e0, least(1e0, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12))), 5) AS similarity
      FROM flat f JOIN centre c ON c.label = f.label AND c.i = f.i GROUP BY f.label, vec_id)) WHERE rank <= 10"""
S["semantic_blend"] = with_parts("", "bm25_top").rstrip() + f""", {CENTRES}
  SELECT query_id, doc, round(sem, 4) AS semantic_score,
    round((0.7e0 * (score / max(score) OVER (PARTITION BY query_id)) + 0.3e0 * sem) * max(score) OVER (PARTITION BY query_id), 4) AS blended
  FROM (SELECT query_id, doc, score, greatest(0e0, least(1e0, coalesce(
      sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12), 0e0))) AS sem
    FROM bm25_top b JOIN (SELECT DISTINCT label FROM centre) l ON b.query_id % 10 = l.label
    LEFT JOIN flat f ON f.vec_id = b.doc LEFT JOIN centre c ON c.label = l.label AND c.i = f.i GROUP BY query_id, doc, score)"""
S["dense_max_chunk"] = f"""WITH {CENTRES}
  SELECT CAST(query_id AS BIGINT) AS query_id, doc, round(max(s), 5) AS value FROM (
    SELECT p.label AS query_id, p.doc, f.vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)) + 1e-12) AS s
    FROM (SELECT DISTINCT label, vec_id % 50 AS doc FROM embeddings) p JOIN flat f ON f.vec_id % 50 = p.doc
    JOIN centre c ON c.label = p.label AND c.i = f.i GROUP BY ALL) GROUP BY ALL"""

STATEMENTS = S
