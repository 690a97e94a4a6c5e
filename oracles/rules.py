"""Statements for diffs, conflicts and the patch guard.

The patches are built from line items, so what a parser must find in them can be
stated from the line items directly.
"""

from __future__ import annotations

from .graphs import hops
from .parts import PART_PATH, with_parts

S: dict[str, str] = {}
ITEMS = """
  items AS MATERIALIZED (
    SELECT l_orderkey AS patch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS hunk,
      'pkg/p' || l_partkey || '.py' AS file, l_linenumber * 10 AS pos, l_linenumber % 3 AS kind, 'f' || l_suppkey AS func, 'C' || l_suppkey AS cls,
      CAST(l_quantity AS INTEGER) AS q, l_returnflag AS rf, l_linestatus AS ls, l_partkey, l_suppkey FROM lineitem)"""
S["diff_hunks"] = f"""WITH {ITEMS}
  SELECT patch_id, hunk, file, pos AS old_start, 2 AS old_count, pos AS new_start, 2 AS new_count, 'class ' || cls || ':' AS context,
    CASE kind WHEN 0 THEN '    return ' || (q + 1) WHEN 1 THEN 'def ' || func || '(self, ' || rf || ', ' || ls || '):' ELSE '++ gone' END AS added,
    CASE kind WHEN 0 THEN '    return ' || q ELSE 'def ' || func || '(self, ' || rf || '):' END AS removed FROM items"""
S["signature_changes"] = f"""WITH {ITEMS}
  SELECT patch_id, hunk, file, func AS symbol, CASE kind WHEN 1 THEN 'signature' ELSE 'removed' END AS change, 'func' AS kind,
    'self, ' || rf AS before, CASE kind WHEN 1 THEN 'self, ' || rf || ', ' || ls ELSE '' END AS after FROM items WHERE kind > 0"""
S["touched_symbols"] = f"""WITH {ITEMS}
  SELECT patch_id, hunk, file, cls AS symbol FROM items UNION ALL SELECT patch_id, hunk, file, func FROM items WHERE kind > 0"""
S["changed_files"] = f"WITH {ITEMS} SELECT DISTINCT patch_id, file FROM items"

ORDERS = """
  work AS MATERIALIZED (SELECT o_orderkey AS id, 'dev' || (o_custkey % 20) AS author, o_orderstatus AS status,
    'pkg/p' || l_partkey || '.py' AS file, 'C' || l_suppkey AS symbol FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  mine AS MATERIALIZED (SELECT DISTINCT id AS ticket, author, file FROM work WHERE status = 'O'),
  theirs AS MATERIALIZED (SELECT DISTINCT id AS pr, author, file FROM work WHERE status = 'F')"""
S["conflicts_v1"] = f"""WITH {ORDERS}
  SELECT ticket, pr, t.author, count(*) AS n_shared, string_agg(file, ',' ORDER BY file) AS files
  FROM mine m JOIN theirs t USING (file) WHERE m.author <> t.author GROUP BY ticket, pr, t.author"""
CLAIMS = f"""
  claim_now AS (SELECT max(o_orderdate) AS now FROM orders),
  last_claim AS MATERIALIZED (
    SELECT * FROM (SELECT o_orderkey, o_custkey AS ticket, 'dev' || (o_custkey % 20) AS author, o_orderdate,
      CASE o_orderstatus WHEN 'P' THEN 'released' ELSE 'active' END AS status,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
      FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) WHERE r = 1),
  claims AS MATERIALIZED (
    SELECT o_orderkey, ticket, author, CASE WHEN now > o_orderdate + INTERVAL 7 DAY THEN 'stale' ELSE status END AS status,
      o_orderdate + INTERVAL 7 DAY AS expires_at FROM last_claim, claim_now WHERE status <> 'released'),
  claim_files AS MATERIALIZED (SELECT DISTINCT ticket, author, {PART_PATH} AS file FROM claims JOIN lineitem ON l_orderkey = o_orderkey WHERE status = 'active')"""
S["claim_conflicts"] = f"""WITH {CLAIMS},
  mine AS (SELECT DISTINCT o_orderkey AS ticket, 'dev' || (o_custkey % 20) AS author, {PART_PATH} AS file
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O')
  SELECT m.ticket, c.ticket AS claim, c.author, count(*) AS n_shared, string_agg(file, ',' ORDER BY file) AS files
  FROM mine m JOIN claim_files c USING (file) WHERE m.author <> c.author GROUP BY m.ticket, c.ticket, c.author"""
GRADED = f"""{ORDERS}, {ITEMS},
  pr_file AS MATERIALIZED (SELECT patch_id AS pr, file, count(DISTINCT func) FILTER (kind > 0) AS n_breaking FROM items GROUP BY ALL),
  pr_symbol AS (SELECT DISTINCT patch_id AS pr, file, cls AS symbol FROM items),
  graded AS MATERIALIZED (
    SELECT m.ticket, t.pr, m.file, CASE WHEN n_breaking > 0 THEN 'signature' WHEN s.symbols IS NOT NULL THEN 'hard' ELSE 'soft' END AS severity,
      coalesce(s.symbols, '') AS overlapping, CAST(n_breaking AS INTEGER) AS n_breaking
    FROM mine m JOIN theirs t ON t.file = m.file AND t.author <> m.author JOIN pr_file p ON p.pr = t.pr AND p.file = t.file
    LEFT JOIN (SELECT w.id AS ticket, x.pr, x.file, string_agg(DISTINCT x.symbol, ',' ORDER BY x.symbol) AS symbols
      FROM pr_symbol x JOIN work w ON w.symbol = x.symbol AND w.status = 'O' JOIN mine mm ON mm.ticket = w.id AND mm.file = x.file GROUP BY ALL) s
    ON s.ticket = m.ticket AND s.pr = t.pr AND s.file = m.file)"""
S["conflicts_graduated"] = f"WITH {GRADED} SELECT * FROM graded"
S["guidance"] = f"""WITH {GRADED}, c AS (
    SELECT ticket, count(*) FILTER (severity = 'signature') AS signature, count(*) FILTER (severity = 'hard') AS hard,
      count(*) FILTER (severity = 'soft') AS soft FROM graded GROUP BY ticket)
  SELECT *, CASE WHEN signature > 0 THEN 'BLOCK: ' || signature || ' signature change(s) upstream'
    WHEN hard > 0 THEN 'CAUTION: ' || hard || ' hard conflict(s) on same symbols' ELSE 'NOTE: ' || soft || ' soft overlap(s) on same files' END AS advice FROM c"""
BACK = "back AS MATERIALIZED (SELECT dst AS src, src AS dst FROM sparse WHERE src < dst)"
GUARD = f""", {ITEMS}, {BACK}, {hops(3, 'back')},
  called AS (SELECT DISTINCT 'pkg/p' || (l_partkey + 1) || '.py' AS file, 'f' || l_suppkey AS func FROM lineitem),
  broken AS MATERIALIZED (SELECT DISTINCT patch_id, file, func, kind FROM items WHERE kind > 0),
  reasons AS MATERIALIZED (
    SELECT patch_id, b.file, 'block' AS severity, 'breaking_signature' AS code, b.func AS subject FROM broken b JOIN called USING (file, func)
    UNION SELECT patch_id, file, 'warn', 'signature_change_no_callers_tracked', func FROM broken b
      WHERE kind = 1 AND NOT EXISTS (SELECT 1 FROM called c WHERE c.file = b.file AND c.func = b.func)
    UNION SELECT patch_id, file, CASE c_custkey % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'warn' ELSE 'info' END,
      'violates_' || CASE c_custkey % 4 WHEN 0 THEN 'avoid' WHEN 1 THEN 'failed' ELSE 'pattern' END, CAST(c_custkey AS VARCHAR)
      FROM items JOIN customer ON l_partkey = c_custkey WHERE kind = 1 AND c_custkey % 4 < 3
    UNION SELECT patch_id, file, 'warn', 'high_impact_radius', CAST(total AS VARCHAR) FROM items
      JOIN (SELECT seed, count(*) AS total FROM visited GROUP BY seed HAVING count(*) >= 10) v ON v.seed = l_partkey)"""
S["patch_reasons"] = with_parts(GUARD + " SELECT * FROM reasons", "sparse")
S["patch_verdicts"] = with_parts(GUARD + """
  SELECT patch_id, CASE max(CASE severity WHEN 'block' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) WHEN 3 THEN 'block' WHEN 2 THEN 'warn' ELSE 'ok' END AS verdict,
    count(code) AS n_reasons FROM (SELECT DISTINCT l_orderkey AS patch_id FROM lineitem) LEFT JOIN reasons USING (patch_id) GROUP BY patch_id""", "sparse")

STATEMENTS = S
