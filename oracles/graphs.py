"""Statements for change coupling, graphs, walks and derived sources."""

from __future__ import annotations

from .parts import code_tokens, with_parts

S: dict[str, str] = {}
S["commit_ages"] = with_parts("SELECT commit, CAST(age AS INTEGER) AS age FROM commits", "commits")
S["cochange_edges"] = with_parts('SELECT "left", "right", weight FROM pairs', "pairs")
PAIRS = """SELECT a.file AS "left", b.file AS "right", round(sum(pow(2e0, -a.age / 150e0) / (a.n - 1)), 8) AS weight
  FROM {t} a JOIN {t} b USING (commit) WHERE a.file < b.file AND a.n BETWEEN 2 AND {cap} GROUP BY ALL"""
S["cochange_small_commits"] = with_parts(PAIRS.format(t="sized", cap=6), "sized")
S["cochange_recent"] = with_parts("", "commits", "changes").rstrip() + """, recent AS MATERIALIZED (
    SELECT commit, file, age, count(*) OVER (PARTITION BY commit) AS n FROM changes JOIN (
      SELECT commit, row_number() OVER (ORDER BY "at" DESC, commit DESC) - 1 AS age FROM commits
      WHERE commit IN (SELECT commit FROM changes)) USING (commit) WHERE age < 500) """ + PAIRS.format(t="recent", cap=20)
S["adjacency_max"] = with_parts("""
  , rel AS (
    SELECT "left", "right", 0.8e0 * ln(1e0 + weight) AS w FROM pairs UNION ALL
    SELECT "left", "right", 1e0 FROM two UNION ALL
    SELECT DISTINCT a.l_partkey, b.l_partkey, 1.5e0 FROM lineitem a JOIN lineitem b USING (l_orderkey, l_suppkey) WHERE a.l_partkey < b.l_partkey),
  best AS MATERIALIZED (SELECT "left", "right", round(max(w), 6) AS weight FROM rel WHERE w > 0 GROUP BY ALL)
  SELECT "left" AS src, "right" AS dst, weight FROM best UNION ALL SELECT "right", "left", weight FROM best""", "pairs", "two")


def hops(n: int, edges: str) -> str:
    """CTEs ending in ``visited(seed, node, hop)`` over edges(src, dst)."""
    out = ["h0 AS MATERIALIZED (SELECT DISTINCT src AS seed, src AS node, 0 AS hop FROM sparse)"]
    seen = "SELECT seed, node FROM h0"
    for i in range(1, n + 1):
        out.append(f"""h{i} AS MATERIALIZED (SELECT DISTINCT seed, dst AS node, {i} AS hop FROM h{i - 1} JOIN {edges} ON node = src
          WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.seed = h{i - 1}.seed AND s.node = dst))""")
        seen += f" UNION ALL SELECT seed, node FROM h{i}"
    union = " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(1, n + 1))
    return ", ".join(out) + f", visited AS MATERIALIZED ({union})"


BACK = "back AS MATERIALIZED (SELECT dst AS src, src AS dst FROM sparse WHERE src < dst)"
S["impact_radius"] = with_parts(f", {BACK}, {hops(2, 'back')} SELECT seed, node, hop FROM visited", "sparse")
S["impact_summary"] = with_parts(f""", {BACK}, {hops(3, 'back')} SELECT seed, count(*) FILTER (hop = 1) AS direct,
  count(*) FILTER (hop > 1) AS transitive, count(*) AS total FROM visited GROUP BY seed""", "sparse")
S["undirected_reach"] = with_parts(f", {hops(2, 'sparse')} SELECT seed, count(*) AS reached FROM visited GROUP BY seed", "sparse")


def walk(rounds: int, seeds: str, edges: str, per_query: bool = False) -> str:
    """CTEs of a restarted walk, one per round; edges(src, dst, p[, query_id])."""
    key = "w.query_id = s.query_id AND " if per_query else ""
    lone = (f"NOT EXISTS (SELECT 1 FROM {edges} w WHERE {key.replace('s.', 'r.')}w.src = r.node)")
    out = [
        f"""restart AS MATERIALIZED (SELECT query_id, node, weight / sum(weight) OVER (PARTITION BY query_id) AS r FROM ({seeds}) WHERE weight > 0)""",
        f"lone AS MATERIALIZED (SELECT query_id, node FROM restart r WHERE {lone})",
        "s0 AS MATERIALIZED (SELECT query_id, node, r AS score FROM restart)",
    ]
    for i in range(1, rounds + 1):
        out.append(f"""s{i} AS MATERIALIZED (SELECT query_id, node, sum(score) AS score FROM (
          SELECT s.query_id, w.dst AS node, 0.72e0 * s.score * w.p AS score FROM s{i - 1} s JOIN {edges} w ON {key}w.src = s.node
          UNION ALL SELECT query_id, node, 0.28e0 * r FROM restart
          UNION ALL SELECT r.query_id, r.node, r.r * d.m FROM restart r JOIN (
            SELECT query_id, 0.72e0 * sum(score) AS m FROM s{i - 1} JOIN lone USING (query_id, node) GROUP BY query_id) d USING (query_id)) GROUP BY ALL)""")
    return ", ".join(out)


STEP = "step AS MATERIALIZED (SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY src) AS p FROM sparse)"
SEEDS = "SELECT p_brand AS query_id, p_partkey AS node, p_size::DOUBLE AS weight FROM part"
FINAL = " SELECT query_id, node, round(score / sum(score) OVER (PARTITION BY query_id), 6) AS score FROM s{0} WHERE score > 0"
S["pagerank_3_rounds"] = with_parts(f", {STEP}, {walk(3, SEEDS, 'step')}{FINAL.format(3)}", "sparse")
S["pagerank"] = with_parts(f", {STEP}, {walk(24, SEEDS, 'step')}{FINAL.format(24)}", "sparse")
NEAR = """
  seeds AS MATERIALIZED (SELECT p_brand AS query_id, p_partkey AS node, p_size::DOUBLE AS weight FROM part),
  near AS MATERIALIZED (SELECT query_id, node FROM seeds UNION SELECT query_id, dst FROM seeds JOIN sparse ON src = node),
  step AS MATERIALIZED (SELECT a.query_id, src, dst, 1e0 / count(*) OVER (PARTITION BY a.query_id, src) AS p
    FROM near a JOIN sparse ON src = a.node JOIN near b ON b.query_id = a.query_id AND b.node = dst)"""
S["pagerank_near"] = with_parts(f",{NEAR}, {walk(8, 'SELECT * FROM seeds', 'step', True)}{FINAL.format(8)}", "sparse")
S["reverse_lookup"] = with_parts(
    "SELECT dst AS node, src AS other FROM sparse WHERE dst IN (SELECT p_partkey FROM part)", "sparse")
S["symbols_of_files"] = """SELECT l_partkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS symbols
  FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey"""

CODE = r"""
  code AS MATERIALIZED (
    SELECT a.*, b.k AS ok, b.folder AS ofolder, b.type AS otype, b.path AS opath, a.w1 || a.w2 || a.k AS cls,
      lower(a.w1) || '_' || lower(a.w2) AS method, 'make_' || b.type || '_' || b.k AS callee, 'make_' || a.type || '_' || a.k AS maker,
      replace(b.folder, '/', '.') || '.p' || b.k AS target, '../' || replace(b.folder, 'pkg/', '') || '/p' || b.k AS rel
    FROM base a JOIN base b ON (a.k * 7 + 1) % (SELECT count(*) FROM part) = b.k)"""
BASE = r"""
  base AS MATERIALIZED (
    SELECT *, folder || '/p' || k || CASE WHEN ts THEN '.ts' ELSE '.py' END AS path FROM (
      SELECT p_partkey AS k, 'pkg/b' || regexp_extract(p_brand, '(\d+)', 1) AS folder, lower(p_type) AS type, p_name, p_partkey % 5 = 0 AS ts,
        upper(x[1]) || x[2:] AS w1, upper(y[1]) || y[2:] AS w2
      FROM (SELECT *, split_part(p_name, ' ', 1) AS x, split_part(p_name, ' ', 2) AS y FROM part)))"""


def code(final: str) -> str:
    return f"WITH {BASE},{CODE} {final}"


S["import_resolution"] = code("""
  SELECT path, 'os' AS module, NULL::VARCHAR AS resolved FROM code WHERE NOT ts UNION ALL
  SELECT path, target, CASE WHEN opath LIKE '%.py' THEN opath END FROM code WHERE NOT ts UNION ALL
  SELECT path, rel, CASE WHEN opath LIKE '%.ts' THEN opath END FROM code WHERE ts""")
S["code_symbols"] = code("""
  SELECT path, cls AS name, 'class' AS kind, NULL::VARCHAR AS parent, true AS is_public FROM code UNION ALL
  SELECT path, maker, 'function', NULL, true FROM code UNION ALL
  SELECT path, method, 'method', cls, true FROM code WHERE NOT ts""")
S["code_definitions"] = code("""
  SELECT path, lower(cls) AS symbol, 'class' AS kind FROM code UNION ALL
  SELECT path, maker, 'func' FROM code UNION ALL SELECT path, method, 'method' FROM code WHERE NOT ts""")
S["code_qualified"] = code("SELECT path, lower(cls) || '.' || method AS qualified FROM code WHERE NOT ts")
S["code_literals"] = code("""SELECT path, 'unknown ' || p_name || ' value in part' AS literal FROM code WHERE NOT ts""")
S["code_index_symbols"] = code("""
  SELECT path, array_to_string(list_sort(list_distinct(CASE WHEN ts THEN [maker, lower(cls), rel]
    ELSE [lower(cls), method, maker, 'os', 'pkg', callee] END)), ',') AS symbols FROM code""")
S["code_call_edges"] = code("""
  SELECT c.path AS src, d.path AS dst, callee AS symbol FROM code c JOIN (
    SELECT path, maker AS name FROM code UNION ALL SELECT path, cls FROM code UNION ALL SELECT path, method FROM code WHERE NOT ts) d
  ON d.name = c.callee WHERE c.path <> d.path""")
S["code_import_edges"] = code("""
  SELECT DISTINCT path AS src, opath AS dst FROM code WHERE (NOT ts AND opath LIKE '%.py') OR (ts AND opath LIKE '%.ts')""")
S["incremental_graph"] = code("""
  SELECT DISTINCT path AS src, opath AS dst FROM code
  WHERE k % 7 NOT IN (0, 1) AND ok % 7 <> 1 AND ((NOT ts AND opath LIKE '%.py') OR (ts AND opath LIKE '%.ts'))
  UNION ALL SELECT folder || '/n' || k || '.py', path FROM code WHERE k % 7 = 2 AND NOT ts""")
TEXT = """(
  SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS t FROM code UNION ALL
  SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) FROM code UNION ALL
  SELECT path, concat_ws(' ', cls, maker, callee, CASE WHEN NOT ts THEN p_name END, 'return size') FROM code UNION ALL
  SELECT path, CASE WHEN ts THEN concat_ws(' ', 'import x', rel, 'export class function')
    ELSE concat_ws(' ', 'import os', target, method, 'class def self size return raise ValueError unknown value in part from') END FROM code)"""
S["code_boosted_top"] = code(f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT path, term FROM ({code_tokens(TEXT, 'path', 't')})) GROUP BY term""")

PUSH_ROUNDS = 60  # more than are needed: rounds without a node above the threshold change nothing


def push(rounds: int, epsilon: str) -> str:
    """CTEs of the pushed walk, one per round; all parts with edges have unit shares."""
    out = ["p0 AS MATERIALIZED (SELECT query_id, node, 0e0 AS score, weight / sum(weight) OVER (PARTITION BY query_id) AS r FROM (" + SEEDS + ") WHERE weight > 0)"]
    for i in range(1, rounds + 1):
        b = f"p{i - 1}"
        out.append(f"""p{i} AS MATERIALIZED (SELECT query_id, node, sum(score) AS score, sum(r) AS r FROM (
          SELECT query_id, node, score + CASE WHEN r > {epsilon} THEN (1e0 - 0.72e0) * r ELSE 0e0 END AS score, CASE WHEN r > {epsilon} THEN 0e0 ELSE r END AS r FROM {b}
          UNION ALL SELECT query_id, dst, 0e0, 0.72e0 * r * p FROM {b} JOIN step ON src = node WHERE r > {epsilon}
          UNION ALL SELECT a.query_id, a.node, 0e0, a.r * m FROM p0 a JOIN (SELECT query_id, sum(0.72e0 * r) AS m FROM {b} x
            WHERE r > {epsilon} AND NOT EXISTS (SELECT 1 FROM step s WHERE s.src = x.node) GROUP BY query_id) l USING (query_id)) GROUP BY ALL)""")
    return ", ".join(out)


S["pagerank_push"] = with_parts(f""", {STEP}, {push(PUSH_ROUNDS, '1e-5')}
  SELECT query_id, node, round(score / sum(score) OVER (PARTITION BY query_id), 5) AS score FROM p{PUSH_ROUNDS} WHERE score > 0""", "sparse")

S["localizer_imports"] = code("SELECT DISTINCT path AS src, opath AS dst FROM code WHERE path <> opath")
NAMED = """
  said AS MATERIALIZED (SELECT s_suppkey AS query_id, path AS doc, 1e0 AS value FROM supplier JOIN code
    ON k = (s_suppkey * 13 + 5) % (SELECT count(*) FROM part) WHERE NOT ts)"""
S["qualified_channel"] = code(f", {NAMED} SELECT * FROM said")
S["import_neighbours"] = code(f""", {NAMED}, e AS MATERIALIZED (SELECT DISTINCT path AS src, opath AS dst FROM code WHERE path <> opath)
  SELECT query_id, doc, max(value) AS value FROM (
    SELECT query_id, dst AS doc, value FROM said JOIN e ON src = doc UNION ALL SELECT query_id, src, value * 0.5e0 FROM said JOIN e ON dst = doc)
  GROUP BY ALL""")

STATEMENTS = S
