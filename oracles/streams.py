"""Statements for the final results of the streaming jobs."""

from __future__ import annotations

from .parts import set_tokens, with_parts
from .state import RECENT

S: dict[str, str] = {}
S["stream_rolling_500"] = with_parts(RECENT + """
  SELECT tool, count, errors, n, mean_ms FROM (SELECT tool, count(*) AS count, count(error) AS errors FROM calls GROUP BY tool)
  JOIN (SELECT tool, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms FROM recent GROUP BY tool) USING (tool)""", "calls")
S["stream_claim_expiry"] = """
  WITH o AS (SELECT o_custkey AS ticket, o_orderdate AS at0, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS before FROM orders),
  s AS (SELECT *, sum(CASE WHEN before IS NULL OR at0 > before + INTERVAL 7 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY ticket ORDER BY at0) AS grp FROM o),
  g AS (SELECT ticket, min(at0) AS first_claim, max(at0) + INTERVAL 7 DAY AS expires_at, count(*) AS n_claims FROM s GROUP BY ticket, grp)
  SELECT ticket, strftime(first_claim, '%Y-%m-%d') AS first_claim, strftime(expires_at, '%Y-%m-%d') AS expires_at, n_claims
  FROM g WHERE expires_at <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY"""
S["stream_ingest"] = """
  SELECT event_id AS commit_hash, CASE event_type WHEN 'error' THEN 'avoid' WHEN 'click' THEN 'failed' WHEN 'view' THEN 'pattern'
      WHEN 'signup' THEN 'decision' ELSE 'noise' END AS classification,
    event_type IN ('error', 'signup') OR (event_type IN ('click', 'view') AND n >= 3) AS promoted,
    CASE WHEN event_type IN ('error', 'signup') THEN 'high' WHEN event_type IN ('click', 'view') AND n >= 3 THEN 'medium' ELSE 'low' END AS confidence,
    'module' AS scope_type, 'b' || (user_id % 5) AS scope_value
  FROM (SELECT *, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events)"""
S["stream_late_dedup"] = "SELECT event_id, event_type, value FROM events"

S["stream_promotions"] = """
  SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'avoid' WHEN 'click' THEN 'failed' WHEN 'view' THEN 'pattern'
      WHEN 'signup' THEN 'decision' ELSE 'noise' END AS classification,
    event_type IN ('error', 'signup') OR (event_type IN ('click', 'view') AND n >= 3) AS promoted,
    CASE WHEN event_type IN ('error', 'signup') THEN 'high' WHEN event_type IN ('click', 'view') AND n >= 3 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN event_type = 'error' THEN 'breaking change or revert' WHEN event_type = 'signup' THEN 'architectural decision'
      WHEN event_type NOT IN ('click', 'view') THEN 'low-signal prefix (docs:)' WHEN n >= 3 THEN 'recurring pattern (' || n || ' occurrences)'
      ELSE 'insufficient signal' END AS reason
  FROM (SELECT *, count(*) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events)"""
S["stream_superseded"] = f"""
  WITH d AS (
    SELECT event_id AS seq, 'decision: migrate area' || user_id || ' to store' || regexp_extract(props, '"k": (\\d+)', 1) || ' by team' || (user_id % 7) AS content
    FROM events WHERE event_type = 'signup'),
  t AS MATERIALIZED (SELECT seq, list_sort(list(term)) AS s FROM ({set_tokens('d', 'seq', 'content')}) GROUP BY seq),
  p AS (
    SELECT a.seq AS old_seq, b.seq AS new_seq, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS total FROM t a JOIN t b ON a.seq < b.seq)
  SELECT old_seq, min(new_seq) AS new_seq, round(arg_min(c / (total - c)::DOUBLE, new_seq), 6) AS similarity FROM p WHERE c / (total - c)::DOUBLE >= 0.35
  GROUP BY old_seq"""

STATEMENTS = S
