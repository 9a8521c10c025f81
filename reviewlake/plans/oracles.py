"""For each registered query, the same result as SQL over the same tables."""

_BUGS = """
  SELECT DISTINCT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem WHERE l_linestatus = 'O'
"""
_REPORTED = """
  SELECT DISTINCT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25
"""
_SCORED = f"""
  bugs AS ({_BUGS}),
  reported AS ({_REPORTED}),
  scored AS (
    SELECT b.run, b.line, EXISTS (
      SELECT 1 FROM reported i WHERE i.run = b.run AND abs(i.line - b.line) <= 2) AS caught
    FROM bugs b)
"""
_DETECTED = """
  detected AS (
    SELECT run, count(*) AS expected, count(*) FILTER (WHERE caught) AS caught,
      string_agg('B' || line, '|' ORDER BY line) FILTER (WHERE NOT caught) AS missed
    FROM scored GROUP BY run)
"""
_ISSUES = """
  issues AS (
    SELECT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS line, 'E' || l_linenumber AS issue_id,
      CASE max(l_returnflag) WHEN 'R' THEN 'High' WHEN 'A' THEN 'Medium' ELSE 'Low' END AS severity,
      max(l_linestatus) = 'F' AS fixed, min(l_partkey) AS part
    FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
_RUNS = """
  test_runs AS (
    SELECT l_orderkey AS run, count(*) AS n, l_orderkey % 7 = 3 AS crashed,
      count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'N') AS op,
      count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS orf,
      count(*) FILTER (WHERE l_linestatus = 'F') AS ot,
      count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS fp,
      count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS ff,
      count(*) FILTER (WHERE l_linestatus = 'O') AS ft
    FROM lineitem GROUP BY l_orderkey)
"""


def _verified(n_cases: str) -> str:
    def side(name: str, passed: str, failed: str, total: str) -> str:
        # No result row: no counts.  A crash reports no tests: every case failed.
        return f"""
      CASE WHEN {total} > 0 THEN CASE WHEN crashed THEN 0 ELSE {passed} END END AS {name}_passed,
      CASE WHEN {total} > 0 THEN CASE WHEN crashed THEN {n_cases} ELSE {failed} END END AS {name}_failed,
      CASE WHEN {total} > 0 THEN CASE WHEN crashed THEN {n_cases} ELSE {total} END END AS {name}_total"""

    return side("original", "op", "orf", "ot") + "," + side("fixed", "fp", "ff", "ft")


def _secs(ms: str) -> str:
    tenths = f"(({ms} + 50) // 100)"
    return f"({tenths} // 10) || '.' || ({tenths} % 10) || 's'"


def _time(ms: str) -> str:
    tenths = f"(({ms} + 3000) // 6000)"
    up = f"CASE WHEN {ms} % 1000 > 500 OR ({ms} % 1000 = 500 AND ({ms} // 1000) % 2 = 1) THEN 1 ELSE 0 END"
    return (
        f"CASE WHEN {ms} >= 60000 THEN ({tenths} // 10) || '.' || ({tenths} % 10) || ' min' "
        f"ELSE ({ms} // 1000 + {up}) || 's' END"
    )


_STAGE = "CASE {n} WHEN 0 THEN 'analyze' WHEN 1 THEN 'fix' WHEN 2 THEN 'test' ELSE 'report' END"
_PROGRESS = f"""
  progress AS (
    SELECT user_id AS run, event_id, ts, {_STAGE.format(n='(event_id % 4)')} AS stage,
      CASE WHEN event_type IN ('click', 'view') THEN 'running'
           WHEN event_type IN ('purchase', 'signup') THEN 'done' ELSE 'error' END AS status,
      CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) END AS ms
    FROM events)
"""
_STATES = """
  states AS (
    SELECT run, stage, arg_max(status, (ts, event_id)) AS status,
      arg_max(ms, (ts, event_id)) FILTER (WHERE ms IS NOT NULL) AS ms
    FROM progress GROUP BY run, stage)
"""
_PAIRS = """
  titled AS (
    SELECT doc_id, source, text, split_part(text, chr(10), 1) AS title FROM documents),
  firsts AS (SELECT title, min(doc_id) AS base_id FROM titled GROUP BY title HAVING count(*) > 1),
  pairs AS (
    SELECT f.base_id, o.doc_id, o.source, b.text AS lhs, o.text AS rhs
    FROM firsts f JOIN titled b ON b.doc_id = f.base_id
      JOIN titled o ON o.title = f.title AND o.doc_id <> f.base_id)
"""
# The table of common subsequences of every pair, a row per left line from the last to the first: cell j counts the
# lines still in common from line i on the left and j on the right.  Then the path from the first lines: equal lines
# are taken, else the right line is skipped where that loses nothing.
_ALIGNED = f"""
  {_PAIRS},
  split AS (
    SELECT base_id, doc_id, source,
      string_split(replace(lhs, chr(13) || chr(10), chr(10)), chr(10)) AS a,
      string_split(replace(rhs, chr(13) || chr(10), chr(10)), chr(10)) AS b FROM pairs),
  cells AS (
    SELECT base_id, doc_id, a, b, len(a) AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS r FROM split
    UNION ALL
    SELECT base_id, doc_id, a, b, i - 1,
      list_reduce(list_concat([[0::BIGINT]], list_transform(list_reverse(range(len(b))), lambda j: [j])),
        lambda done, j: list_prepend(
          CASE WHEN a[i] = b[j[1] + 1] THEN r[j[1] + 2] + 1 ELSE greatest(r[j[1] + 1], done[1]) END, done))
    FROM cells WHERE i > 0),
  tables AS (SELECT base_id, doc_id, list(r ORDER BY i) AS t FROM cells GROUP BY base_id, doc_id),
  path AS (
    SELECT base_id, doc_id, 0 AS i, 0 AS j, 0 AS block, NULL::VARCHAR AS op FROM split
    UNION ALL
    SELECT base_id, doc_id, i + (op <> '+')::INT, j + (op <> '-')::INT, block + (op = '=')::INT, op
    FROM (
      SELECT p.base_id, p.doc_id, p.i, p.j, p.block,
        CASE WHEN p.i < len(s.a) AND p.j < len(s.b) AND s.a[p.i + 1] = s.b[p.j + 1] THEN '='
             WHEN p.j < len(s.b) AND (p.i = len(s.a) OR t.t[p.i + 1][p.j + 2] >= t.t[p.i + 2][p.j + 1]) THEN '+'
             ELSE '-' END AS op
      FROM path p JOIN split s USING (base_id, doc_id) JOIN tables t USING (base_id, doc_id)
      WHERE p.i < len(s.a) OR p.j < len(s.b))),
  numbered AS (
    SELECT base_id, doc_id, i, j, op, block,
      row_number() OVER (PARTITION BY base_id, doc_id, block, op ORDER BY i, j) AS k
    FROM path WHERE op IS NOT NULL),
  aligned AS (
    SELECT base_id, doc_id, block - 1 AS block, 1 AS late, 1 AS k, i AS left_no, j AS right_no FROM numbered WHERE op = '='
    UNION ALL
    SELECT coalesce(l.base_id, r.base_id), coalesce(l.doc_id, r.doc_id), coalesce(l.block, r.block), 0, coalesce(l.k, r.k), l.i, r.j
    FROM (SELECT * FROM numbered WHERE op = '-') l
      FULL JOIN (SELECT * FROM numbered WHERE op = '+') r USING (base_id, doc_id, block, k))
"""
_RENDERED = (
    "'Part ' || p_name || ' of ' || p_brand || ': ' || p_type || ', ' || p_name || "
    "' {unknown} {{{{ name }}}}' || chr(10) || 'end'"
)
# White space as JavaScript trims it; the texts hold none but these.
_TRIM = r"regexp_replace({x}, '^[\s\x{{feff}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+|[\s\x{{feff}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\v]+$', '', 'g')"

_INDEX = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'src/order' || o_orderkey || '.ts' AS "fileName",
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS "recordedAt",
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS author,
  coalesce(n, 0) AS issues
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey
) ON l_orderkey = o_orderkey
"""

ORACLES: dict[str, str] = {
    "detection": f"""
WITH {_SCORED}
SELECT run, count(*) AS expected, count(*) FILTER (WHERE caught) AS caught
FROM scored GROUP BY run
""",
    "missed": f"""
WITH {_SCORED}
SELECT run, 'B' || line AS bug_id, line FROM scored WHERE NOT caught
""",
    "detection_optional": f"""
WITH {_SCORED}, {_DETECTED}
SELECT o.o_orderkey AS run, d.expected, d.caught
FROM orders o LEFT JOIN detected d ON d.run = o.o_orderkey
""",
    "severity_counts": """
SELECT l_orderkey AS run,
  count(*) FILTER (WHERE l_returnflag = 'R') AS high,
  count(*) FILTER (WHERE l_returnflag = 'A') AS medium,
  count(*) FILTER (WHERE l_returnflag = 'N') AS low
FROM lineitem GROUP BY l_orderkey
""",
    "report_card": f"""
WITH {_SCORED}, {_DETECTED}, {_ISSUES}, {_RUNS},
  counts AS (
    SELECT run, count(*) AS issues,
      count(*) FILTER (WHERE severity = 'High') AS high,
      count(*) FILTER (WHERE severity = 'Medium') AS medium,
      count(*) FILTER (WHERE severity = 'Low') AS low,
      count(*) FILTER (WHERE fixed) AS fixes
    FROM issues GROUP BY run),
  verified AS (
    SELECT t.run, {_verified('c.issues')} FROM test_runs t JOIN counts c ON c.run = t.run),
  times AS (
    SELECT l_orderkey AS run, CAST(sum(CAST(l_quantity AS BIGINT)) * 731 AS BIGINT) AS ms
    FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey AS run, coalesce(c.issues, 0) AS issues,
  coalesce(c.high, 0) || ' high · ' || coalesce(c.medium, 0) || ' medium · ' || coalesce(c.low, 0) || ' low' AS severities,
  coalesce(c.fixes, 0) AS fixes, coalesce(c.issues, 0) AS cases,
  d.caught || '/' || d.expected AS bugs_caught,
  CASE WHEN d.expected IS NULL THEN NULL WHEN d.missed IS NULL THEN 'none missed'
       ELSE 'missed: ' || replace(d.missed, '|', ', ') END AS bugs_missed,
  v.original_passed || ' → ' || v.fixed_passed AS tests_passing,
  v.fixed_total,
  CASE WHEN t.ms % 2 = 1 THEN {_secs('t.ms')} END AS pipeline_time
FROM orders o LEFT JOIN counts c ON c.run = o.o_orderkey
  LEFT JOIN verified v ON v.run = o.o_orderkey
  LEFT JOIN detected d ON d.run = o.o_orderkey
  LEFT JOIN times t ON t.run = o.o_orderkey
""",
    "issues_fixed": """
WITH done AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F')
SELECT l.l_orderkey AS run, 'E' || l.l_linenumber AS issue_id, l.l_partkey AS part,
  d.l_orderkey IS NOT NULL AS fixed
FROM lineitem l LEFT JOIN done d ON d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber
""",
    "case_guards": """
WITH cases AS (
    SELECT p_partkey AS run,
      CASE WHEN p_size % 2 = 0 THEN '[E' || (p_size % 7 + 1) || '] ' || p_name ELSE p_name END AS name,
      CASE WHEN p_size % 2 = 0 THEN 'E' || (p_size % 7 + 1) END AS issue_id
    FROM part),
  firsts AS (
    SELECT l_partkey AS run, 'E' || l_linenumber AS issue_id, l_returnflag,
      row_number() OVER (PARTITION BY l_partkey, l_linenumber
        ORDER BY l_orderkey, l_suppkey, l_quantity, l_returnflag) AS rn
    FROM lineitem)
SELECT c.run, c.name, c.issue_id,
  CASE WHEN c.issue_id IS NULL THEN 'edge / happy path' ELSE 'guards ' || c.issue_id END AS guards,
  CASE f.l_returnflag WHEN 'R' THEN 'High' WHEN 'A' THEN 'Medium' WHEN 'N' THEN 'Low' END AS severity,
  f.run IS NOT NULL AS known
FROM cases c LEFT JOIN firsts f ON f.rn = 1 AND f.run = c.run AND f.issue_id = c.issue_id
""",
    "verification": f"""
WITH {_RUNS}, verified AS (SELECT run, {_verified('n')} FROM test_runs)
SELECT *, original_failed = 0 AND original_total > 0 AS original_ok,
  fixed_failed = 0 AND fixed_total > 0 AS fixed_ok
FROM verified
""",
    "missing_artifacts": """
WITH required(n) AS (VALUES (1), (2), (3), (4), (5))
SELECT o.o_orderkey AS run,
  CASE r.n WHEN 1 THEN 'analysis.json'
    WHEN 2 THEN 'fixed' || CASE WHEN o.o_orderkey % 2 = 0 THEN '.ts' ELSE '.js' END
    WHEN 3 THEN 'fixes.json' WHEN 4 THEN '*.test.ts' ELSE 'report.json' END AS missing
FROM orders o CROSS JOIN required r
WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = r.n)
""",
    "upsert_index": """
SELECT CAST(o_custkey AS VARCHAR) AS id, 'src/order' || o_orderkey || '.ts' AS file_name,
  strftime(o_orderdate, '%Y-%m-%d') AS recorded_at,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS author
FROM orders
QUALIFY row_number() OVER (
  PARTITION BY o_custkey
  ORDER BY o_orderdate >= '1999-01-01' DESC, o_orderdate DESC, o_orderkey DESC) = 1
""",
    "assemble": f"""
WITH {_SCORED}, {_DETECTED}, {_ISSUES}, {_RUNS},
  named AS (
    SELECT *, CASE WHEN fixed THEN '[' || issue_id || '] ' ELSE '' END || 'part ' || part AS case_name
    FROM issues),
  lists AS (
    SELECT run, count(*) AS n,
      string_agg(issue_id || ':' || severity || ':part ' || part, '|' ORDER BY line) AS issues,
      string_agg(issue_id, '|' ORDER BY line) FILTER (WHERE fixed) AS fixes,
      string_agg(case_name, '|' ORDER BY line) AS cases
    FROM named GROUP BY run),
  verified AS (SELECT t.run, {_verified('l.n')} FROM test_runs t JOIN lists l ON l.run = t.run)
SELECT CAST(o.o_orderkey AS VARCHAR) AS run, 'src/order' || o.o_orderkey || '.ts' AS "fileName",
  CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderstatus END AS author,
  CASE WHEN o.o_orderpriority LIKE '1%' THEN 'High' WHEN o.o_orderpriority LIKE '5%' THEN 'Low' ELSE 'Medium' END AS risk,
  coalesce(l.issues, '') AS issues, coalesce(l.fixes, '') AS fixes, coalesce(l.cases, '') AS cases,
  CASE WHEN v.original_total IS NOT NULL AND v.fixed_total IS NOT NULL THEN v.fixed_passed END AS fixed_passed,
  d.expected, d.caught,
  CASE WHEN d.expected IS NOT NULL THEN coalesce(d.missed, '') END AS missed
FROM orders o LEFT JOIN lists l ON l.run = o.o_orderkey
  LEFT JOIN verified v ON v.run = o.o_orderkey
  LEFT JOIN detected d ON d.run = o.o_orderkey
""",
    "flatten_report": f"""
WITH {_ISSUES}
SELECT CAST(run AS VARCHAR) AS run,
  CAST(row_number() OVER (PARTITION BY run ORDER BY line) - 1 AS BIGINT) AS pos,
  issue_id, 'Logical' AS type, 'part ' || part AS description, line, severity,
  CASE WHEN part % 2 = 0 THEN 'replace it' END AS suggestion
FROM issues JOIN orders ON o_orderkey = run
""",
    "index_entries": _INDEX,
    "published_index": _INDEX,
    "analyze_prompts": f"""
WITH requests AS (SELECT doc_id, {_TRIM.format(x='text')} AS code FROM documents),
  sized AS (
    SELECT *, length(code) + length(regexp_replace(code, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS units
    FROM requests),
  numbered AS (
    SELECT doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line
    FROM (SELECT doc_id, string_split(code, chr(10)) AS lines FROM sized WHERE code <> '' AND units <= 20000))
SELECT doc_id, 'doc' || doc_id || '.ts' AS file_name,
  'Review this typescript code.' || chr(10) || chr(10) || string_agg(n || '| ' || line, chr(10) ORDER BY n)
    || chr(10) || chr(10) || 'Return {{{{shape}}}}' || chr(10) AS prompt
FROM numbered GROUP BY doc_id
""",
    "to_lines": """
SELECT doc_id, CAST(generate_subscripts(lines, 1) AS BIGINT) AS line_no, unnest(lines) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
""",
    "number_lines": """
SELECT doc_id, string_agg(n || '| ' || line, chr(10) ORDER BY n) AS numbered
FROM (
  SELECT doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
GROUP BY doc_id
""",
    "render_template": f"""
SELECT p_partkey, {_RENDERED.format(unknown='{{unknown}}')} AS prompt FROM part
""",
    "fill_placeholders": f"""
SELECT p_partkey, {_RENDERED.format(unknown='–')} AS slide FROM part
""",
    "extract_json": r"""
SELECT event_id,
  CAST(json_extract(regexp_extract('note ' || props || ' end', '(?s)\{.*\}'), '$.k') AS BIGINT) AS k,
  CAST(NULL AS VARCHAR) AS reason
FROM events
""",
    "extract_json_bad": r"""
SELECT CASE WHEN span = '' THEN 'no_object' WHEN json_valid(span) THEN 'ok' ELSE 'bad_json' END AS reason,
  count(*) AS pages
FROM (SELECT regexp_extract(html, '(?s)\{.*\}') AS span FROM pages)
GROUP BY 1
""",
    "extract_cases": r"""
SELECT p_partkey, CAST(0 AS BIGINT) AS pos, '[E' || p_size || '] ' || p_name AS name, 'E' || p_size AS issue_id FROM part
UNION ALL
SELECT p_partkey, CAST(1 AS BIGINT), p_name || ' it''s ', NULL FROM part
UNION ALL
SELECT p_partkey, CAST(2 AS BIGINT), '[X1] ' || p_name || ' [E7][E8]', 'E7' FROM part
""",
    "file_meta": """
SELECT doc_id,
  'doc' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.d' ELSE '' END AS name,
  CASE WHEN doc_id % 4 = 1 THEN '.js' ELSE '.ts' END AS ext,
  CASE WHEN doc_id % 4 = 1 THEN 'javascript' ELSE 'typescript' END AS language,
  'src/' || source || '/doc' || doc_id ||
    CASE doc_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '.d.ts' END AS file_name
FROM documents WHERE doc_id % 4 <> 2
""",
    "run_id_filter": """
SELECT 'run' || CASE o_orderstatus WHEN 'P' THEN '_' ELSE '-' END || o_orderkey AS run
FROM orders WHERE o_orderstatus <> 'F'
""",
    "fmt_duration": f"""
SELECT l_orderkey, l_linenumber, {_secs('ms')} AS secs, {_time('ms')} AS time
FROM (SELECT *, l_orderkey * 37 % 200000 + l_linenumber * 50 AS ms FROM lineitem)
""",
    "validate_requests": f"""
WITH requests AS (
    SELECT doc_id,
      CASE WHEN doc_id % 50 = 0 THEN '' ELSE {_TRIM.format(x='text')} END AS code,
      CASE doc_id % 7 WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' END AS language,
      CASE WHEN doc_id % 11 = 1 THEN repeat('f', CAST(doc_id % 240 AS INTEGER)) END AS file_name
    FROM documents),
  sized AS (
    SELECT *, length(code) + length(regexp_replace(code, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')) AS units
    FROM requests)
SELECT doc_id, coalesce(language, 'typescript') AS language, coalesce(file_name, 'snippet.ts') AS file_name,
  CASE WHEN code = '' THEN 'Paste some code first.'
       WHEN units > 20000 THEN 'Keep it under 20,000 characters.'
       WHEN language = 'python' THEN 'Invalid option: expected one of "typescript"|"javascript"'
       WHEN length(file_name) > 120 THEN 'Too big: expected string to have <=120 characters' END AS reason,
  md5(code) AS code_md5, length(code) AS n
FROM sized
""",
    "validate_records": """
SELECT event_id,
  CASE event_id % 8 WHEN 1 THEN 'bad_field' WHEN 2 THEN 'bad_field' WHEN 4 THEN 'bad_field'
    WHEN 6 THEN 'bad_json' WHEN 7 THEN 'bad_json' END AS reason,
  CASE WHEN event_id % 8 IN (1, 2, 4) THEN 'k' END AS bad_path,
  CASE WHEN event_id % 8 IN (0, 5) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events
""",
    "flatten_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "scan_secrets": r"""
SELECT doc_id, 'src/' || source || '/doc' || doc_id || '.ts' AS path, line_no
FROM (
  SELECT doc_id, source, CAST(generate_subscripts(lines, 1) AS BIGINT) AS line_no, unnest(lines) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents))
WHERE regexp_matches(line, '(?i)(api[_-]?key|secret|token|password|bearer|apikey)\s*[:=]')
""",
    "stage_timings": """
WITH placed AS (
    SELECT event_id // 6 AS run, epoch_us(ts) AS us,
      CASE WHEN (event_id // 6) % 5 = 0 AND event_id % 6 = 1 THEN 5
           WHEN (event_id // 6) % 5 = 0 AND event_id % 6 = 5 THEN 1 ELSE event_id % 6 END AS n
    FROM events),
  wide AS (
    SELECT run, max(us) FILTER (WHERE n = 0) AS t0, max(us) FILTER (WHERE n = 1) AS ta,
      greatest(max(us) FILTER (WHERE n = 2), max(us) FILTER (WHERE n = 3)) AS tf,
      count(*) FILTER (WHERE n IN (2, 3)) AS nf,
      max(us) FILTER (WHERE n = 4) AS tt, max(us) FILTER (WHERE n = 5) AS tr
    FROM placed GROUP BY run),
  gated AS (
    SELECT *, coalesce(nf = 2 AND t0 < ta AND ta <= tf AND tf <= tt AND tt <= tr, false) AS ok FROM wide)
SELECT run, CASE WHEN ok THEN (ta - t0 + 500) // 1000 END AS analyze_ms,
  CASE WHEN ok THEN (tf - ta + 500) // 1000 END AS fix_ms,
  CASE WHEN ok THEN (tt - tf + 500) // 1000 END AS test_ms,
  CASE WHEN ok THEN (tr - tt + 500) // 1000 END AS report_ms,
  CASE WHEN ok THEN (tr - t0 + 500) // 1000 END AS total_ms
FROM gated
""",
    "first_valid_attempt": f"""
WITH attempts AS (
    SELECT event_id // 12 AS run, {_STAGE.format(n='((event_id // 3) % 4)')} AS stage,
      event_id % 3 + 1 AS attempt, epoch_us(ts) AS started,
      epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) AS ended,
      CASE event_type WHEN 'error' THEN 'no_object' WHEN 'signup' THEN 'bad_field' END AS error,
      CAST(json_extract(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_id % 3 < 2),
  folded AS (
    SELECT run, stage, min(attempt) FILTER (WHERE error IS NULL) AS attempt,
      arg_min(k, attempt) FILTER (WHERE error IS NULL) AS result,
      arg_max(error, attempt) AS last_error,
      arg_min(ended, attempt) FILTER (WHERE error IS NULL) AS won,
      max(ended) AS ended, min(started) AS started
    FROM attempts GROUP BY run, stage)
SELECT run, stage, attempt, result, CASE WHEN attempt IS NULL THEN last_error END AS error,
  (coalesce(won, ended) - started + 500) // 1000 AS elapsed_ms
FROM folded
""",
    "stage_state": f"WITH {_PROGRESS}, {_STATES} SELECT run, stage, status, ms FROM states",
    "stage_elapsed": f"""
WITH {_PROGRESS}, spans AS (
  SELECT run, stage, max(epoch_us(ts)) FILTER (WHERE status = 'done')
    - min(epoch_us(ts)) FILTER (WHERE status = 'running') AS us
  FROM progress GROUP BY run, stage)
SELECT run, stage, CASE WHEN us >= 0 THEN (us + 500) // 1000 END AS elapsed_ms FROM spans
""",
    "stage_progress": f"""
WITH {_PROGRESS}, {_STATES},
  stages(stage_no, stage) AS (VALUES (0, 'analyze'), (1, 'fix'), (2, 'test'), (3, 'report'))
SELECT r.run, s.stage_no, s.stage, coalesce(t.status, 'pending') AS status,
  {_secs('t.ms')} AS seconds
FROM (SELECT DISTINCT run FROM progress) r CROSS JOIN stages s
  LEFT JOIN states t ON t.run = r.run AND t.stage = s.stage
""",
    "run_outcome": """
WITH stops AS (
    SELECT user_id, min((ts, event_id)) AS stop, arg_min(event_id, (ts, event_id)) AS stop_id
    FROM events WHERE event_type = 'error' GROUP BY user_id),
  seen AS (
    SELECT e.*, s.stop_id
    FROM events e LEFT JOIN stops s ON s.user_id = e.user_id
    WHERE s.user_id IS NULL OR (e.ts, e.event_id) <= s.stop)
SELECT user_id AS run,
  CASE WHEN max(stop_id) IS NOT NULL THEN 'error'
       WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN 'result' ELSE 'open' END AS outcome,
  'failed at ' || max(stop_id) AS message,
  arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS report,
  count(*) AS events_read
FROM seen GROUP BY user_id
""",
    "seen_state": f"""
WITH stops AS (
    SELECT user_id, min((ts, event_id)) AS stop FROM events WHERE event_type = 'error' GROUP BY user_id),
  seen AS (
    SELECT e.user_id AS run, {_STAGE.format(n='(e.event_id % 4)')} AS stage, e.ts, e.event_id,
      CASE WHEN e.event_type IN ('click', 'view') THEN 'running' ELSE 'done' END AS status,
      CAST(round(e.value * 100) AS BIGINT) AS ms
    FROM events e LEFT JOIN stops s ON s.user_id = e.user_id
    WHERE e.event_type IN ('click', 'view', 'signup')
      AND (s.user_id IS NULL OR (e.ts, e.event_id) < s.stop))
SELECT run, stage, arg_max(status, (ts, event_id)) AS status, arg_max(ms, (ts, event_id)) AS ms
FROM seen GROUP BY run, stage
""",
    "line_delta": f"""
WITH {_PAIRS},
  sides AS (
    SELECT base_id, doc_id, unnest(string_split(replace(lhs, chr(13) || chr(10), chr(10)), chr(10))) AS line, 1 AS l, 0 AS r FROM pairs
    UNION ALL
    SELECT base_id, doc_id, unnest(string_split(replace(rhs, chr(13) || chr(10), chr(10)), chr(10))), 0, 1 FROM pairs),
  counted AS (
    SELECT base_id, doc_id, line, sum(l) AS l, sum(r) AS r FROM sides GROUP BY base_id, doc_id, line)
SELECT base_id, doc_id, CAST(sum(least(l, r)) AS BIGINT) AS common,
  CAST(sum(l - least(l, r)) AS BIGINT) AS removed, CAST(sum(r - least(l, r)) AS BIGINT) AS added
FROM counted GROUP BY base_id, doc_id
""",
    "side_by_side": f"""
WITH RECURSIVE {_ALIGNED}
SELECT x.base_id, x.doc_id,
  CAST(row_number() OVER (PARTITION BY x.base_id, x.doc_id ORDER BY block, late, k) - 1 AS BIGINT) AS pos,
  CASE late WHEN 1 THEN 'same' ELSE 'changed' END AS kind,
  s.a[left_no] AS "left", s.b[right_no] AS "right",
  CAST(left_no AS BIGINT) AS left_no, CAST(right_no AS BIGINT) AS right_no
FROM aligned x JOIN split s USING (base_id, doc_id)
""",
    "diff_stats": f"""
WITH RECURSIVE {_ALIGNED},
  counted AS (
    SELECT source, count(*) AS n, count(*) FILTER (WHERE late = 0) AS differing
    FROM aligned JOIN split USING (base_id, doc_id) GROUP BY source)
SELECT source, n AS "rows", differing, CAST(differing * 1000000 // n AS BIGINT) AS ppm FROM counted
""",
    "flatten_fixes": f"""
WITH {_ISSUES}
SELECT CAST(run AS VARCHAR) AS run,
  CAST(row_number() OVER (PARTITION BY run ORDER BY line) - 1 AS BIGINT) AS pos,
  issue_id, 'fixed part ' || part AS change
FROM issues JOIN orders ON o_orderkey = run WHERE fixed
""",
    "flatten_cases": f"""
WITH {_ISSUES}
SELECT CAST(run AS VARCHAR) AS run,
  CAST(row_number() OVER (PARTITION BY run ORDER BY line) - 1 AS BIGINT) AS pos,
  CASE WHEN fixed THEN '[' || issue_id || '] ' ELSE '' END || 'part ' || part AS name,
  CASE WHEN fixed THEN issue_id END AS issue_id
FROM issues JOIN orders ON o_orderkey = run
""",
    "flatten_test_runs": f"""
WITH {_ISSUES}, {_RUNS},
  verified AS (
    SELECT t.run, {_verified('i.n')}
    FROM test_runs t JOIN (SELECT run, count(*) AS n FROM issues GROUP BY run) i ON i.run = t.run
      JOIN orders ON o_orderkey = t.run)
SELECT CAST(run AS VARCHAR) AS run, 'original' AS version, original_passed AS passed, original_failed AS failed,
  original_total AS total FROM verified WHERE original_total IS NOT NULL AND fixed_total IS NOT NULL
UNION ALL
SELECT CAST(run AS VARCHAR), 'fixed', fixed_passed, fixed_failed, fixed_total
FROM verified WHERE original_total IS NOT NULL AND fixed_total IS NOT NULL
""",
    "headline": f"""
WITH {_SCORED}, {_DETECTED}, {_ISSUES}, {_RUNS},
  counts AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE fixed) AS fixes FROM issues GROUP BY run),
  verified AS (SELECT t.run, {_verified('c.n')} FROM test_runs t JOIN counts c ON c.run = t.run),
  shown AS (SELECT * FROM verified WHERE original_total IS NOT NULL AND fixed_total IS NOT NULL)
SELECT CAST(o.o_orderkey AS VARCHAR) AS run,
  coalesce(c.n, 0) || ' found, ' || coalesce(c.fixes, 0) || ' fixed, ' || coalesce(CAST(v.original_passed AS VARCHAR), '–')
    || ' to ' || coalesce(CAST(v.fixed_passed AS VARCHAR), '–') || ' of ' || coalesce(CAST(v.fixed_total AS VARCHAR), '–')
    || ', ' || coalesce(CAST(d.caught AS VARCHAR), '–') || '/' || coalesce(CAST(d.expected AS VARCHAR), '–') AS headline
FROM orders o LEFT JOIN counts c ON c.run = o.o_orderkey LEFT JOIN shown v ON v.run = o.o_orderkey
  LEFT JOIN detected d ON d.run = o.o_orderkey
""",
    "validate_reports": """
SELECT CAST(o_orderkey AS VARCHAR) AS run,
  CASE WHEN o_orderkey % 16 IN (13, 14) THEN 'bad_json' WHEN o_orderkey % 16 IN (0, 12, 15) THEN NULL ELSE 'bad_field' END AS reason,
  CASE o_orderkey % 16 WHEN 1 THEN 'schemaVersion' WHEN 2 THEN 'title' WHEN 3 THEN 'language' WHEN 4 THEN 'source.kind'
    WHEN 5 THEN 'source.recordedAt' WHEN 6 THEN 'source.model' WHEN 7 THEN 'originalCode' WHEN 8 THEN 'analysis.risk_level'
    WHEN 9 THEN 'analysis.errors.1.line' WHEN 10 THEN 'tests.cases' WHEN 11 THEN 'report.recommendations.1' END AS bad_path
FROM orders
""",
    "bad_fields": """
SELECT CAST(o_orderkey AS VARCHAR) AS run, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) - 1 AS pos, bad_path
FROM (SELECT DISTINCT o_orderkey FROM orders) o JOIN (VALUES (1, 1, 'schemaVersion'), (2, 2, 'title'), (3, 3, 'language'), (4, 4, 'source.kind'),
  (6, 5, 'source.model'), (5, 6, 'source.recordedAt'), (7, 7, 'originalCode'), (9, 8, 'analysis.errors.1.line'),
  (8, 9, 'analysis.risk_level'), (10, 10, 'tests.cases'), (11, 11, 'report.recommendations.1')) swaps(number, place, bad_path)
  ON number IN (o_orderkey % 12, (o_orderkey // 12) % 12)
""",
    "test_results": """
SELECT CAST(o_orderkey AS VARCHAR) AS run, v AS version, o_orderkey % 10 AS passed,
  CASE v WHEN 'fixed' THEN 0::BIGINT ELSE 2::BIGINT END AS failed, 12::BIGINT AS total
FROM orders, (VALUES ('original'), ('fixed')) versions(v) WHERE o_orderkey % 13 NOT IN (1, 2, 3)
""",
    "rejected_results": """
SELECT CAST(o_orderkey AS VARCHAR) AS run, v AS version,
  CASE o_orderkey % 13 WHEN 1 THEN 'bad_json' ELSE 'bad_field' END AS reason,
  CASE o_orderkey % 13 WHEN 2 THEN 'numPassedTests' WHEN 3 THEN 'numFailedTests' END AS bad_path
FROM orders, (VALUES ('original'), ('fixed')) versions(v) WHERE o_orderkey % 13 IN (1, 2, 3)
""",
    "truth_bugs": """
SELECT o_orderkey AS run, n AS pos, 'bug-' || n AS bug_id, o_orderkey % 40 + n * 3 AS line,
  CASE WHEN n <> 1 THEN o_orderpriority END AS description
FROM orders, (VALUES (0::BIGINT), (1), (2), (3)) numbers(n) WHERE n < o_orderkey % 5
""",
    "parse_events": f"""
WITH e AS (
  SELECT *, CASE WHEN event_id % 17 IN (3, 4) THEN 'bad' WHEN event_type = 'error' THEN 'error'
    WHEN event_type = 'purchase' THEN 'result' ELSE 'stage' END AS kind FROM events)
SELECT event_id, CASE kind WHEN 'bad' THEN 'error' ELSE kind END AS type,
  CASE WHEN kind = 'stage' THEN {_STAGE.format(n='(event_id % 4)')} END AS stage,
  CASE WHEN kind = 'stage' THEN CASE WHEN event_type IN ('click', 'view') THEN 'running' ELSE 'done' END END AS status,
  CASE WHEN kind = 'stage' AND event_id % 2 = 0 THEN CAST(round(value * 100) AS DOUBLE) END AS ms,
  CAST(NULL AS VARCHAR) AS error,
  CASE kind WHEN 'bad' THEN 'bad_json' WHEN 'error' THEN 'failed at ' || event_id END AS message,
  CASE WHEN kind = 'result' THEN replace(props, ' ', '') END AS report
FROM e
""",
    "logged_events": f"""
WITH e AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'result' ELSE 'stage' END AS kind FROM events)
SELECT CAST(user_id AS VARCHAR) AS run, event_id AS seq, kind AS type, {_STAGE.format(n='(event_id % 4)')} AS stage,
  CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type IN ('purchase', 'signup') THEN 'done' ELSE 'error' END AS status,
  CASE WHEN kind = 'stage' THEN CAST(round(value * 100) AS DOUBLE) END AS ms,
  CASE WHEN kind = 'error' THEN 'failed at ' || event_id END AS message,
  CASE WHEN kind = 'result' THEN replace(props, ' ', '') END AS report
FROM e
""",
    "event_lines": f"""
WITH e AS (
  SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'result' ELSE 'stage' END AS kind FROM events)
SELECT '{{"run":' || user_id || ',"seq":' || event_id || ',"type":"' || kind || '","stage":"'
  || {_STAGE.format(n='(event_id % 4)')} || '","status":"'
  || CASE WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type IN ('purchase', 'signup') THEN 'done' ELSE 'error' END || '"'
  || CASE kind WHEN 'stage' THEN ',"ms":' || CAST(round(value * 100) AS BIGINT) ELSE '' END
  || CASE kind WHEN 'error' THEN ',"message":"failed at ' || event_id || '"' ELSE '' END
  || CASE kind WHEN 'result' THEN ',"report":' || props ELSE '' END || '}}' AS value
FROM e
""",
    "iso_times": """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso,
  CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) // 1000 END AS ms
FROM events
""",
    "contract_audit": f"""
WITH {_ISSUES}, {_RUNS},
  fixes AS (
    SELECT l_orderkey AS run, 'E' || (l_linenumber + l_partkey % 2) AS issue_id, count(*) AS n
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
  verified AS (
    SELECT t.run, {_verified('i.n')}
    FROM test_runs t JOIN (SELECT run, count(*) AS n FROM issues GROUP BY run) i ON i.run = t.run),
  advice AS (SELECT p_partkey AS run, p_size % 6 AS n,
      2 * (p_size % 14 + 1) AS words FROM part),
  broken AS (
    SELECT 'ids_in_order' AS rule, run, 1 AS n FROM issues WHERE part % 11 = 0
    UNION ALL
    SELECT 'line_exists', i.run, 1 FROM issues i JOIN orders o ON o.o_orderkey = i.run
    WHERE i.line > o.o_orderkey % 7 + 1
    UNION ALL
    SELECT 'clean_is_low', o_orderkey, 1 FROM orders o
    WHERE o_orderpriority NOT LIKE '5%' AND NOT EXISTS (SELECT 1 FROM issues i WHERE i.run = o.o_orderkey)
    UNION ALL
    SELECT 'urgent_is_fixed', i.run, 1 FROM issues i
    WHERE i.severity IN ('High', 'Medium')
      AND NOT EXISTS (SELECT 1 FROM fixes f WHERE f.run = i.run AND f.issue_id = i.issue_id)
    UNION ALL
    SELECT 'one_fix_per_issue', run, 1 FROM fixes WHERE n > 1
    UNION ALL
    SELECT 'fix_of_known_issue', f.run, 1 FROM fixes f
    WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.run = f.run AND i.issue_id = f.issue_id)
    UNION ALL
    SELECT 'fixed_is_tested', f.run, 1 FROM fixes f JOIN issues i ON i.run = f.run AND i.issue_id = f.issue_id
    WHERE NOT i.fixed
    UNION ALL
    SELECT 'tests_prove_fix', run, 1 FROM verified WHERE NOT coalesce(fixed_failed = 0 AND original_failed > 0, false)
    UNION ALL
    SELECT 'cases_match_tests', run, 1 FROM (
      SELECT run, CASE WHEN fixed THEN issue_id ELSE '' END || part AS name, count(*) FILTER (WHERE line = 6) AS lost
      FROM issues GROUP BY 1, 2) WHERE lost > 0
    UNION ALL
    SELECT 'recommendation_count', run, 1 FROM advice WHERE n NOT BETWEEN 2 AND 4
    UNION ALL
    SELECT 'recommendation_length', run, n FROM advice WHERE words >= 20 AND n > 0
    UNION ALL
    SELECT 'tag_is_issue', run, 1 FROM issues WHERE line = 4)
SELECT rule, run, CAST(sum(n) AS BIGINT) AS violations FROM broken GROUP BY rule, run
""",
}
