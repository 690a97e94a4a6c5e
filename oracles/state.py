"""Statements for operational state, feedback, claims and call metrics."""

from __future__ import annotations

from .parts import PART_PATH, set_tokens, with_parts
from .rules import CLAIMS

S: dict[str, str] = {}
NEWEST = "SELECT * FROM pred_pr QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY id DESC) = 1"
S["precision_recall"] = with_parts(f"""
  SELECT ticket_id, prec AS "precision", rec AS "recall",
    CASE WHEN prec_raw + rec_raw > 0 THEN round(2e0 * prec_raw * rec_raw / (prec_raw + rec_raw), 3) ELSE 0e0 END AS f1,
    CAST(tp AS INTEGER) AS tp, CAST(np - tp AS INTEGER) AS fp, CAST(na - tp AS INTEGER) AS fn
  FROM (SELECT *, tp / np::DOUBLE AS prec_raw, coalesce(tp / nullif(na, 0)::DOUBLE, 0) AS rec_raw FROM ({NEWEST}))""", "pred_pr")
S["raw_events"] = """
  SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events WHERE event_type <> 'purchase'"""
S["latest_prediction"] = with_parts(f"SELECT ticket_id, id, CAST(np AS INTEGER) AS n_files FROM ({NEWEST})", "pred_pr")
S["reconcile"] = with_parts("""
  SELECT ticket_id, outcome, status, prec AS "precision", rec AS "recall", feedback FROM reconciled""", "reconciled")
S["auto_tune"] = with_parts("""
  , ev AS (
    SELECT o_custkey % 50 AS id, ticket_id * 1000000 AS seq, CASE feedback WHEN 'hit' THEN 1 ELSE -1 END AS delta FROM reconciled WHERE feedback IS NOT NULL
    UNION ALL SELECT o_custkey + 100, ticket_id * 1000000 + 1, CASE feedback WHEN 'hit' THEN 1 ELSE -1 END FROM reconciled WHERE feedback IS NOT NULL),
  run AS (SELECT id, seq, delta, sum(delta) OVER (PARTITION BY id ORDER BY seq) AS d FROM ev),
  mem AS (SELECT DISTINCT c_custkey % 50 AS id FROM customer UNION ALL SELECT c_custkey + 100 FROM customer),
  per AS (SELECT id, count(*) FILTER (delta = 1) AS h, count(*) FILTER (delta = -1) AS m, count(*) FILTER (d >= 3) AS bumps,
    arg_max(CASE WHEN d >= 3 THEN 'active' ELSE 'suspect' END, seq) FILTER (abs(d) >= 3) AS turned FROM run GROUP BY id)
  SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(h, 0) AS INTEGER) AS hit_count, CAST(coalesce(m, 0) AS INTEGER) AS miss_count,
    coalesce(turned, CASE WHEN id % 3 = 0 THEN 'suspect' ELSE 'active' END) AS status,
    round(least(1e0, 0.5e0 + 0.1e0 * coalesce(bumps, 0)), 6) AS score FROM mem LEFT JOIN per USING (id)""", "reconciled")
STATS = """
  SELECT 'shop' AS project, count(*) AS total, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'reverted') AS reverted,
    count(*) FILTER (outcome = 'abandoned') AS abandoned, round(avg(prec) FILTER (outcome <> 'abandoned' AND p.id IS NOT NULL), 3) AS avg_precision,
    round(avg(rec) FILTER (outcome <> 'abandoned' AND p.id IS NOT NULL), 3) AS avg_recall, count(*) FILTER (outcome <> 'abandoned' AND p.id IS NOT NULL) AS samples
  FROM outs o LEFT JOIN ({p}) p USING (ticket_id) WHERE created_at >= (SELECT max(created_at) FROM outs) - INTERVAL 365 DAY"""
S["feedback_stats_latest"] = with_parts(STATS.replace("{p}", NEWEST), "outs", "pred_pr")
S["feedback_stats_fanout"] = with_parts(STATS.replace("{p}", "SELECT * FROM pred_pr"), "outs", "pred_pr")
S["memory_health"] = """SELECT doc_id AS id, quality AS hit_count, toxic * 2 AS miss_count, toxic * 2 - quality AS delta
  FROM labels WHERE quality > 0 OR toxic > 0 ORDER BY delta DESC, id DESC LIMIT 20"""
S["memory_levels"] = """
  SELECT o_orderkey, score, CASE WHEN score >= 0.7 THEN 1 WHEN score >= 0.4 THEN 2 ELSE 3 END AS level FROM (
    SELECT o_orderkey, round(greatest(0e0, 1e0 - age / 30e0) * 0.35e0 + least(1e0, (o_custkey % 12) / 10e0) * 0.30e0
      + least(1e0, (o_orderkey % 7) / 5e0) * 0.20e0 + CASE o_orderpriority WHEN '1-URGENT' THEN 1e0 ELSE 0e0 END * 0.15e0, 3) AS score
    FROM (SELECT *, date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) % 45 AS age FROM orders))"""
MEM = """
  mem AS MATERIALIZED (
    SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'repo' WHEN 'AUTOMOBILE' THEN 'module' WHEN 'MACHINERY' THEN 'file'
        WHEN 'HOUSEHOLD' THEN 'branch' ELSE 'ticket' END AS scope_type,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'b' || (c_custkey % 7) || '/p1' || (c_custkey % 10) WHEN 'MACHINERY' THEN 'b' || (c_custkey % 6) || '/p' || c_custkey
        WHEN 'HOUSEHOLD' THEN 'branch' || (c_custkey % 5) END AS scope_value,
      CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'suspect' END AS status, verified
    FROM customer JOIN (SELECT o_custkey, max(o_orderdate) AS verified FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""
S["memory_by_status"] = f"WITH {MEM} SELECT status, scope_type, count(*) AS n FROM mem GROUP BY ALL"
SWEEP = f"""{MEM}, t AS (SELECT max(o_orderdate) AS now FROM orders),
  changed AS MATERIALIZED (SELECT DISTINCT {PART_PATH} AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey, t WHERE o_orderdate >= now - INTERVAL 30 DAY),
  marked AS MATERIALIZED (SELECT *, CASE
      WHEN scope_type = 'branch' THEN scope_value IN (SELECT 'branch' || (s_suppkey % 3) FROM supplier)
      WHEN scope_type IN ('file', 'module') THEN EXISTS (SELECT 1 FROM changed WHERE contains(path, scope_value)) ELSE true END AS touched FROM mem),
  swept AS MATERIALIZED (SELECT id, status, touched, CASE WHEN verified < now - INTERVAL 90 DAY THEN 'stale'
      WHEN verified < now - INTERVAL 60 DAY THEN CASE WHEN touched THEN 'stale' ELSE 'suspect' END
      WHEN touched AND verified < now - INTERVAL 14 DAY THEN 'suspect' ELSE 'active' END AS new_status FROM marked, t)"""
S["staleness_sweep"] = f"WITH {SWEEP} SELECT * FROM swept"
S["staleness_counts"] = f"WITH {SWEEP} SELECT CASE WHEN status = new_status THEN 'unchanged' ELSE new_status END AS outcome, count(*) AS n FROM swept GROUP BY 1"
S["latest_per_key"] = """SELECT user_id, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
S["upsert_view"] = """SELECT * FROM (SELECT user_id, event_type, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) WHERE value >= 1"""
S["last_session"] = """SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars FROM conversations
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""
S["l1_context"] = """
  SELECT conv_id, role, string_agg(md5(text), ',' ORDER BY r) AS items FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations)
  WHERE r <= CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END GROUP BY conv_id, role"""
PROMO = """
  , cls AS MATERIALIZED (SELECT *, CASE WHEN message LIKE 'revert:%' THEN 'avoid' WHEN message LIKE 'refactor:%' THEN 'decision'
      WHEN message LIKE 'fix:%' THEN 'failed' WHEN message LIKE 'feat:%' THEN 'pattern' ELSE 'noise' END AS classification,
      count(*) OVER (PARTITION BY left(message, 30)) AS n_similar FROM messages),
  dec AS MATERIALIZED (SELECT *, CASE WHEN message LIKE 'docs:%' THEN 'low-signal prefix (docs:)' WHEN message LIKE 'revert:%' THEN 'breaking change or revert'
      WHEN message LIKE 'refactor:%' THEN 'architectural decision' WHEN n >= 3 THEN 'semantic commit with multi-file impact (' || n || ' files)'
      WHEN n_similar >= 3 THEN 'recurring pattern (' || n_similar || ' occurrences)' ELSE 'insufficient signal' END AS reason FROM cls)"""
S["promotion"] = with_parts(PROMO + """
  SELECT commit AS commit_hash, classification, classification <> 'noise' AND reason <> 'insufficient signal' AS promoted,
    CASE WHEN reason LIKE 'low-%' OR reason LIKE 'insuf%' THEN 'low' WHEN reason LIKE 'break%' OR reason LIKE 'arch%' THEN 'high' ELSE 'medium' END AS confidence,
    reason, classification || ': ' || message AS content FROM dec""", "messages")
S["scope_inference"] = with_parts("""
  SELECT commit AS commit_hash, CASE WHEN n <= 5 AND d = 1 THEN 'module' ELSE 'repo' END AS scope_type, CASE WHEN n <= 5 AND d = 1 THEN dir END AS scope_value
  FROM (SELECT commit, any_value(n) AS n, count(DISTINCT split_part(f, '/', 1)) AS d, min(split_part(f, '/', 1)) AS dir
    FROM (SELECT commit, n, unnest(files) AS f FROM messages) GROUP BY commit)""", "messages")
S["prefix_frequency"] = with_parts("SELECT lower(left(subject, 30)) AS prefix, count(*) AS n FROM commits GROUP BY 1", "commits")
S["claims_expiry"] = f"""WITH {CLAIMS}
  SELECT ticket, author, status, strftime(expires_at, '%Y-%m-%d') AS expires, CAST(count(DISTINCT {PART_PATH}) AS INTEGER) AS n_files
  FROM claims JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
S["claims_overlap"] = f"""WITH {CLAIMS}
  SELECT ticket, author, string_agg(file, ',' ORDER BY file) AS overlap FROM claim_files WHERE file IN (
    SELECT {PART_PATH} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT') GROUP BY ALL"""
S["similar_tickets"] = with_parts(f"""
  , fresh AS MATERIALIZED (SELECT doc_id, text, source FROM documents),
  tt AS MATERIALIZED ({set_tokens('issues', 'query_id', 'text')}), mt AS MATERIALIZED ({set_tokens('fresh', 'doc_id', 'text')}),
  tn AS (SELECT query_id, count(*) AS a FROM tt GROUP BY 1), mn AS (SELECT doc_id, count(*) AS b FROM mt GROUP BY 1),
  sh AS (SELECT query_id, doc_id, count(*) AS c FROM tt JOIN mt USING (term) GROUP BY ALL),
  scored AS (SELECT i.query_id, f.doc_id, least(1e0, coalesce(c / (a + b - c)::DOUBLE, 0) + CASE WHEN
      contains('src' || (i.query_id % 20) || '/x.py', f.source) THEN 0.2e0 ELSE 0e0 END) AS total
    FROM issues i, fresh f LEFT JOIN tn ON tn.query_id = i.query_id LEFT JOIN mn ON mn.doc_id = f.doc_id
    LEFT JOIN sh ON sh.query_id = i.query_id AND sh.doc_id = f.doc_id
    WHERE NOT regexp_matches(f.text, '(?i)(?:ticket|issue|PR)\\s*#?\\s*' || i.query_id || '(?:[^0-9]|$)'))
  SELECT query_id AS ticket_id, doc_id AS memory_id, similarity, rank FROM (
    SELECT query_id, doc_id, round(total, 3) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 3) DESC, doc_id DESC) AS rank
    FROM scored WHERE total >= 0.2) WHERE rank <= 5""", "issues")
S["paired_arm_means"] = """
  WITH per AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL)
  SELECT event_type, count(*) AS n, round(avg(v), 4) AS mean_value FROM per
  WHERE user_id IN (SELECT user_id FROM per GROUP BY user_id HAVING count(*) = 2) GROUP BY event_type"""
RECENT = ", recent AS MATERIALIZED (SELECT * FROM calls QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, seq DESC) <= 500)"
LIFE = "SELECT tool, count(*) AS count, count(error) AS errors, round(count(error) / count(*)::DOUBLE, 3) AS error_rate FROM calls GROUP BY tool"
S["tool_percentiles"] = with_parts(RECENT + f"""
  SELECT * FROM ({LIFE}) JOIN (SELECT tool, round(avg(duration_ms), 2) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 2) AS p50_ms,
    round(quantile_cont(duration_ms, 0.95), 2) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 2) AS p99_ms, round(max(duration_ms), 2) AS max_ms,
    CAST(floor(avg(output_size)) AS BIGINT) AS avg_size, max(output_size) AS max_size FROM recent GROUP BY tool) USING (tool)""", "calls")
S["error_rates"] = with_parts(LIFE, "calls")
S["errors_by_type"] = with_parts("SELECT tool, error, count(*) AS n FROM calls WHERE error IS NOT NULL GROUP BY ALL", "calls")
S["last_errors"] = with_parts("""
  SELECT tool, error || ': ' || left(msg, 160) AS last_error FROM calls WHERE error IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY tool ORDER BY ts DESC, seq DESC) = 1""", "calls")
S["rolling_500"] = with_parts(RECENT + " SELECT tool, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms FROM recent GROUP BY tool", "calls")
S["dashboard"] = with_parts(f""", {MEM}
  SELECT 'tools' AS section, tool AS name, count(*) AS value FROM calls GROUP BY tool UNION ALL
  SELECT 'memory', status, count(*) FROM mem GROUP BY status UNION ALL
  SELECT 'feedback', outcome, count(*) FROM outs GROUP BY outcome UNION ALL
  SELECT 'graph', 'import', count(*) FROM sparse""", "calls", "outs", "sparse")

STATEMENTS = S
