"""The catalog's questions as plain SQL, written independently of the Spark code.

Used only to check results: the statements run on a single-node SQL engine over
the same tables. ``PRELUDE`` holds the views that ``bindings.py`` builds.
"""

from __future__ import annotations

from diffloom import fixed_values as fv

NL = "chr(10)"
WS = "'" + fv.WHITESPACE + "'"
SPACE, WORD = fv.SPACE, fv.WORD
DEF_NAME = fv.DEF_NAME_PATTERN


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def indent(x: str) -> str:
    return f"(length({x}) - length(ltrim({x}, {WS})))"


def bucket(word: str) -> str:
    return f"(('0x' || substr(md5({word}), 1, 8))::UBIGINT % {fv.EMBEDDING_DIM})::INTEGER"


def pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({index}) + 1]"


def case_of(value: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {value} {arms} ELSE '{default}' END"


ISSUE_TYPE = case_of("type", {t: t for t in fv.ISSUE_TYPES} | fv.ISSUE_TYPE_ALIASES, "bug")
SEVERITY = case_of("severity", {s: s for s in fv.SEVERITIES} | fv.SEVERITY_ALIASES, "low")
RANK = "list_position(['" + "', '".join(fv.SEVERITIES) + "'], {0}) - 1"
LANGUAGE = case_of("lower(CASE WHEN contains(path, '.') THEN split_part(path, '.', -1) END)",
                   fv.LANGUAGE_BY_EXTENSION, "unknown")
LEVELS = ["info", "low", "medium", "high", "critical", "error", "warning"]
KINDS = ["style", "bug", "performance", "security", "best_practice", "complexity", "maintainability",
         "documentation", "quality"]
ITEM_ID = (
    "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity)::BIGINT, "
    "round(l_extendedprice * 100)::BIGINT, epoch_us(l_shipdate)))"
)

PRELUDE = f"""
WITH files_v AS (
  SELECT doc_id AS file_id, (floor(doc_id / 41.0) * 2 + (CASE WHEN doc_id % 41 >= 20 THEN 1 ELSE 0 END))::BIGINT AS pr_id,
         {pick(['src', 'tests', 'config', 'docs', 'lib'], 'doc_id % 5')} || '/' || source || '/doc_' || doc_id
           || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'es' THEN '.ts' WHEN 'fr' THEN '.md' END AS path,
         CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'renamed' ELSE 'modified' END AS status,
         n_chars % 40 AS additions, n_chars % 13 AS deletions, text AS content
  FROM documents),
file_lines AS (
  SELECT file_id, path, unnest(string_split(content, {NL})) AS raw,
         generate_subscripts(string_split(content, {NL}), 1) AS line_no
  FROM files_v),
code_lines AS (
  SELECT file_id, path, line_no, CASE
    WHEN raw = '' THEN raw
    WHEN odd AND i % 7 = 0 THEN 'def f' || (i % 21) || '():'
    WHEN odd AND i % 7 = 3 THEN 'var x' || i || ' = ' || raw
    WHEN odd AND i % 35 = 5 THEN '    eval(' || raw || ')'
    WHEN odd AND i % 35 = 12 THEN '    q = "SELECT a FROM t WHERE b = " + ' || raw
    WHEN odd AND i % 35 = 19 THEN '    el.innerHTML = ' || raw
    WHEN odd AND i % 35 = 26 THEN '    token = "' || raw || '"'
    WHEN odd AND i % 35 = 33 THEN '    from m import *  # except: ' || raw
    WHEN odd AND i % 35 = 6 THEN '    if a == b: console.log(a) else: for x in y: ' || raw
    WHEN i = 0 THEN 'def f0():'
    ELSE '    ' || raw END AS line
  FROM (SELECT *, line_no - 1 AS i, file_id % 2 = 1 AS odd FROM file_lines)),
code_files AS (
  SELECT f.file_id, f.pr_id, f.path, f.status, f.additions, f.deletions, c.content, {LANGUAGE} AS language
  FROM files_v f JOIN (SELECT file_id, string_agg(line, {NL} ORDER BY line_no) AS content
                       FROM code_lines GROUP BY file_id) c USING (file_id)),
lang_lines AS (
  SELECT l.file_id, l.line_no, l.line, f.language FROM code_lines l JOIN code_files f USING (file_id)),
patched AS (
  SELECT f.*, CASE WHEN f.file_id % 11 = 0 THEN '' ELSE
      '--- a/' || path || {NL} || '+++ b/' || path || {NL} || '@@ @@' || {NL} || p.body END AS patch
  FROM code_files f JOIN (
    SELECT file_id, string_agg((CASE (line_no - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END) || line,
                               {NL} ORDER BY line_no) AS body
    FROM code_lines GROUP BY file_id) p USING (file_id)),
patch_lines AS (
  SELECT file_id, unnest(string_split(patch, {NL})) AS line,
         generate_subscripts(string_split(patch, {NL}), 1) AS line_no FROM patched),
patch_kinds AS (
  SELECT *, CASE WHEN starts_with(line, '+') AND NOT starts_with(line, '+++') THEN 'added'
                 WHEN starts_with(line, '-') AND NOT starts_with(line, '---') THEN 'removed' ELSE 'context' END AS kind,
         coalesce(nullif(regexp_extract(line, 'def{SPACE}+({WORD}+)', 1), ''),
                  nullif(regexp_extract(line, 'function{SPACE}+({WORD}+)', 1), ''),
                  nullif(regexp_extract(line, 'class{SPACE}+({WORD}+)', 1), ''), 'unknown') AS symbol
  FROM patch_lines),
impact AS (
  SELECT p.file_id, p.path, p.status, p.additions, p.deletions, p.patch,
         count(*) FILTER (kind = 'added') AS lines_added, count(*) FILTER (kind = 'removed') AS lines_removed,
         coalesce(list_sort(list_distinct(list(symbol) FILTER (kind <> 'context' AND
           (contains(line, 'def ') OR contains(line, 'function ') OR contains(line, 'class '))))), []) AS functions
  FROM patched p JOIN patch_kinds k USING (file_id) GROUP BY ALL),
change_types AS (
  SELECT file_id, CASE WHEN status = 'added' THEN 'new_file' WHEN status = 'removed' THEN 'deleted_file'
    WHEN status = 'renamed' THEN 'renamed_file' WHEN deletions = 0 THEN 'additions_only'
    WHEN additions = 0 THEN 'deletions_only' WHEN additions > deletions * 3 THEN 'mostly_additions'
    WHEN deletions > additions * 3 THEN 'mostly_deletions' ELSE 'mixed_changes' END AS change_type
  FROM files_v),
impact_scores AS (
  SELECT *, (CASE WHEN patch = '' THEN 0 ELSE least(trunc((((lines_added + lines_removed) * 2 + len(functions) * 10)::DOUBLE) *
      CASE WHEN regexp_matches(path, '\\.(py|js|ts|java)$') THEN 1.2::DOUBLE
           WHEN regexp_matches(path, '\\.(md|txt|json)$') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)::BIGINT, 100) END)::BIGINT AS impact_score
  FROM impact),
risks AS (
  SELECT *, CASE WHEN patch = '' THEN 'low'
    WHEN status = 'added' AND impact_score < 50 THEN 'low'
    WHEN status = 'removed' THEN (CASE base WHEN 'low' THEN 'medium' ELSE 'high' END)
    WHEN regexp_matches(lower(path), 'test|spec|mock') THEN (CASE base WHEN 'high' THEN 'medium' ELSE 'low' END)
    WHEN regexp_matches(lower(path), 'config|setting|env') THEN (CASE base WHEN 'low' THEN 'medium' ELSE 'high' END)
    ELSE base END AS risk_level
  FROM (SELECT *, CASE WHEN impact_score >= 70 THEN 'high' WHEN impact_score >= 35 THEN 'medium' ELSE 'low' END AS base
        FROM impact_scores)),
metrics AS (
  SELECT *, greatest(100 - (CASE WHEN total_lines > 300 THEN least(20, (total_lines - 300) // 50) ELSE 0 END)
      - (CASE WHEN complexity > 10 THEN least(30, (complexity - 10) * 2) ELSE 0 END)
      - trunc(duplication * 40)::INTEGER, 0)::INTEGER AS maintainability
  FROM (
    SELECT file_id, count(*)::INTEGER AS total_lines, count(*) FILTER ({strip('line')} <> '')::INTEGER AS code_lines,
      least(50, 1 + sum({' + '.join(f"contains(lower(line), '{k}')::INTEGER" for k in fv.COMPLEXITY_KEYWORDS)}))::INTEGER AS complexity,
      CASE WHEN count(*) FILTER ({strip('line')} <> '') < 10 THEN 0.0::DOUBLE ELSE
        (count(*) FILTER (length({strip('line')}) > 10) - count(DISTINCT {strip('line')}) FILTER (length({strip('line')}) > 10))::DOUBLE
        / count(*) FILTER ({strip('line')} <> '') END AS duplication
    FROM code_lines GROUP BY file_id)),
plain_metrics AS (
  SELECT *, greatest(100 - (CASE WHEN total_lines > 300 THEN least(20, (total_lines - 300) // 50) ELSE 0 END)
      - (CASE WHEN complexity > 10 THEN least(30, (complexity - 10) * 2) ELSE 0 END)
      - trunc(duplication * 40)::INTEGER, 0)::INTEGER AS maintainability
  FROM (
    SELECT file_id, count(*)::INTEGER AS total_lines, count(*) FILTER ({strip('raw')} <> '')::INTEGER AS code_lines,
      least(50, 1 + sum({' + '.join(f"contains(lower(raw), '{k}')::INTEGER" for k in fv.COMPLEXITY_KEYWORDS)}))::INTEGER AS complexity,
      CASE WHEN count(*) FILTER ({strip('raw')} <> '') < 10 THEN 0.0::DOUBLE ELSE
        (count(*) FILTER (length({strip('raw')}) > 10) - count(DISTINCT {strip('raw')}) FILTER (length({strip('raw')}) > 10))::DOUBLE
        / count(*) FILTER ({strip('raw')} <> '') END AS duplication
    FROM file_lines GROUP BY file_id)),
findings AS (
  SELECT file_id, line_no AS line, 'python.line_length' AS rule_id, 'style' AS type, 'low' AS severity,
         'Line too long (' || length(line) || ' > 88 characters)' AS message,
         'Break long lines for better readability' AS suggestion
  FROM lang_lines WHERE language = 'python' AND length(line) > 88
  UNION ALL SELECT file_id, line_no, 'python.return_type', 'typing', 'low', 'Missing return type annotation',
         'Add return type annotation for better code documentation'
  FROM lang_lines WHERE language = 'python' AND NOT contains(line, '->')
    AND regexp_matches(line, '^{SPACE}*def{SPACE}+{WORD}+{SPACE}*\\([^)]*\\){SPACE}*:')
  UNION ALL SELECT file_id, line_no, 'script.var', 'style', 'medium', 'Use ''let'' or ''const'' instead of ''var''',
         'Replace ''var'' with ''let'' or ''const'' for better scoping'
  FROM lang_lines WHERE language IN ('javascript', 'typescript')
    AND regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])var{SPACE}+')
  UNION ALL SELECT file_id, line_no, 'script.console_log', 'style', 'low', 'Remove console.log statements',
         'Use proper logging library instead of console.log'
  FROM lang_lines WHERE language IN ('javascript', 'typescript') AND contains(line, 'console.log')
  UNION ALL SELECT file_id, line_no, 'security.sql_injection', 'sql_injection', 'high', 'Possible SQL injection',
         'Use parameterised statements'
  FROM lang_lines WHERE regexp_matches(line, '(?i)SELECT.*FROM.*WHERE.*=.*\\+')
    OR regexp_matches(line, '(?i)INSERT.*VALUES.*\\+') OR regexp_matches(line, '(?i)UPDATE.*SET.*=.*\\+')
  UNION ALL SELECT file_id, line_no, 'security.xss', 'xss', 'medium', 'Possible cross-site scripting',
         'Avoid writing unescaped markup or evaluating text'
  FROM lang_lines WHERE regexp_matches(line, 'innerHTML{SPACE}*=') OR contains(line, 'document.write(') OR contains(line, 'eval(')
  UNION ALL SELECT file_id, line_no, 'security.sensitive_data', 'sensitive_data', 'critical', 'Possible hard-coded secret',
         'Load secrets from a protected store'
  FROM lang_lines WHERE regexp_matches(line, '(?i)(password|secret|key|token){SPACE}*={SPACE}*[''"][^''"]+[''"]')
    OR regexp_matches(line, '(?i)api_key{SPACE}*=')),
counts AS (
  SELECT file_id, count(rule_id) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS grave,
         count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
         count(*) FILTER (severity = 'critical') AS critical,
         count(*) FILTER (starts_with(rule_id, 'security.')) AS sec,
         count(*) FILTER (starts_with(rule_id, 'security.') AND severity IN ('critical', 'high')) AS sec_grave,
         count(*) FILTER (starts_with(rule_id, 'security.') AND severity = 'high') AS sec_high,
         count(*) FILTER (starts_with(rule_id, 'security.') AND severity = 'medium') AS sec_medium
  FROM code_files LEFT JOIN findings USING (file_id) GROUP BY file_id),
scored AS (
  SELECT f.file_id, f.pr_id, f.path, f.language, f.additions, f.deletions, m.total_lines, m.code_lines, m.complexity,
         m.duplication, m.maintainability, c.n, c.grave, c.critical, c.sec,
         greatest(least(m.maintainability - 20 * c.grave - 10 * c.high - 5 * c.medium
           - (CASE WHEN m.complexity > 15 THEN (m.complexity - 15) * 2 ELSE 0 END) - trunc(m.duplication * 30)::INTEGER, 100), 0) AS quality,
         greatest(100 - 40 * c.sec_grave - 25 * c.sec_high - 10 * c.sec_medium, 0) AS security
  FROM code_files f JOIN metrics m USING (file_id) JOIN counts c USING (file_id)),
function_rows AS (
  SELECT file_id, line_no, regexp_extract(line, '{DEF_NAME}', 1) AS name, {indent('line')} AS depth,
         {strip('line')} <> '' AS filled,
         sum((regexp_extract(line, '{DEF_NAME}', 1) <> '')::INTEGER) OVER (PARTITION BY file_id ORDER BY line_no) AS seg
  FROM code_lines),
function_segments AS (
  SELECT file_id, seg, line_no AS start, name, depth,
         coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no),
                  (SELECT max(line_no) + 1 FROM code_lines x WHERE x.file_id = r.file_id)) AS next_start
  FROM function_rows r WHERE name <> ''),
function_table AS (
  SELECT file_id, name AS function_name, arg_max(length, start) AS length FROM (
    SELECT s.file_id, s.name, s.start, (coalesce(min(r.line_no), any_value(s.next_start)) - s.start)::BIGINT AS length
    FROM function_segments s LEFT JOIN function_rows r
      ON r.file_id = s.file_id AND r.seg = s.seg AND r.line_no > s.start AND r.filled AND r.depth <= s.depth
    GROUP BY s.file_id, s.name, s.start) GROUP BY file_id, name),
block_lines AS (
  SELECT file_id, line_no, line, sum(first::INTEGER) OVER (PARTITION BY file_id ORDER BY line_no) AS seg FROM (
    SELECT file_id, line_no, line,
           row_number() OVER (PARTITION BY file_id ORDER BY line_no) = 1
             OR regexp_matches({strip('line')}, '^(def|class|function|const|let|var) ') AS first
    FROM code_lines WHERE {strip('line')} <> '')),
blocks AS (
  SELECT file_id, (seg - 1)::INTEGER AS block_no, string_agg(line, {NL} ORDER BY line_no) AS block
  FROM block_lines GROUP BY file_id, seg),
raw_issues AS (
  SELECT {ITEM_ID} AS issue_id, l_orderkey AS pr_id,
         CASE WHEN l_partkey % 20 <> 0 THEN l_orderkey || '-' || l_suppkey END AS file_id,
         {pick(KINDS, 'l_partkey % 9')} AS type, {pick(LEVELS, '(l_partkey + l_linenumber) % 7')} AS severity,
         CASE WHEN l_partkey % 3 = 0 THEN 'title ' || l_partkey END AS title,
         CASE WHEN l_partkey % 4 <> 0 THEN 'message ' || l_partkey END AS message,
         CASE WHEN l_partkey % 2 = 0 THEN 'description ' || l_partkey END AS description,
         l_linenumber AS line, CASE WHEN l_partkey % 5 = 0 THEN (l_partkey % 80)::INTEGER END AS col,
         'r' || (l_partkey % 7) AS rule_id, CASE WHEN l_partkey % 6 = 0 THEN 'do this' END AS suggestion,
         CASE WHEN l_partkey % 6 = 1 THEN 'rather that' END AS recommendation,
         CASE WHEN l_partkey % 8 = 0 THEN 0.5 WHEN l_partkey % 8 = 1 THEN 0.5 ELSE l_discount END AS confidence
  FROM lineitem),
stored_issues AS (
  SELECT issue_id AS id, pr_id AS pr_analysis_id, file_id AS file_analysis_id, {ISSUE_TYPE} AS issue_type, {SEVERITY} AS level,
         coalesce(title, message, 'Unknown issue') AS title, coalesce(message, description, '') AS description,
         line AS line_number, coalesce(col, 0) AS column_number, rule_id,
         coalesce(suggestion, recommendation, '') AS suggestion, confidence::DOUBLE AS confidence
  FROM raw_issues),
file_rows AS (
  SELECT l_orderkey || '-' || l_suppkey AS id, l_orderkey AS pr_analysis_id,
         {pick(['python', 'javascript', 'markdown', ''], 'l_suppkey % 4')} AS file_type,
         trunc(sum(l_quantity) FILTER (l_returnflag = 'A'))::BIGINT AS lines_added,
         trunc(sum(l_quantity) FILTER (l_returnflag = 'R'))::BIGINT AS lines_removed, count(*) AS lines_analyzed
  FROM lineitem GROUP BY l_orderkey, l_suppkey),
tasks AS (
  SELECT o_orderkey AS id, 'https://github.com/team' || (o_custkey % 10) || '/repo' || (o_custkey % 7) AS repo_url,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'processing' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'normal' END AS priority,
         o_custkey % 5 AS retry_count, o_orderdate AS created_at,
         CASE WHEN o_custkey % 9 <> 0 THEN o_orderdate END AS started_at,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_minutes(o_custkey % 90) END AS completed_at
  FROM orders),
all_analyses AS (
  SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN (o_custkey % 2) * 7 END AS total_files,
         CASE WHEN o_custkey % 3 = 1 THEN (o_custkey % 2) * 11 END AS total_issues, (o_custkey % 101)::DOUBLE AS quality_score
  FROM orders),
analyses AS (SELECT * FROM all_analyses WHERE id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 60000)),
task_events AS (
  SELECT user_id AS task_id, event_id AS seq, ts, event_type AS stage,
         CASE event_type WHEN 'signup' THEN 'processing' WHEN 'click' THEN 'retry' WHEN 'purchase' THEN 'completed'
              WHEN 'error' THEN 'failed' END AS state,
         CASE WHEN event_type = 'view' THEN trunc(value)::INTEGER END AS progress,
         CASE WHEN event_id % 5 <> 0 THEN event_type || ' ' || event_id END AS message
  FROM events),
event_progress AS (
  SELECT *, CASE WHEN state = 'completed' THEN 100 WHEN progress IS NOT NULL THEN greatest(0, least(100, progress))
                 WHEN state = 'processing' THEN 0 END AS stored FROM task_events),
urls AS (
  SELECT page_id * 2 AS url_id, url FROM pages
  UNION ALL SELECT page_id * 2 + 1, CASE page_id % 8 WHEN 0 THEN https WHEN 1 THEN https || '/' WHEN 2 THEN https || '.git'
    WHEN 3 THEN 'git@github.com:' || owner || '/' || repo || '.git' WHEN 4 THEN '  ' || https || {NL}
    WHEN 5 THEN https || '/pull/7' WHEN 6 THEN 'https://github.com/' || owner
    ELSE 'https://example.com/' || owner || '/' || repo END
  FROM (SELECT page_id, 'team-' || (page_id % 97) AS owner, 'repo.' || page_id AS repo,
               'https://github.com/team-' || (page_id % 97) || '/repo.' || page_id AS https FROM pages)),
url_parts AS (
  SELECT *, regexp_matches(u, '^https://github\\.com/[\\p{{L}}\\p{{N}}_\\-.]+/[\\p{{L}}\\p{{N}}_\\-.]+/?$') AS is_https,
         regexp_matches(u, '^git@github\\.com:[\\p{{L}}\\p{{N}}_\\-.]+/[\\p{{L}}\\p{{N}}_\\-.]+\\.git$') AS is_ssh,
         regexp_extract(u, '^git@github\\.com:([^/]+)/(.+)\\.git$', 1) AS ssh_owner,
         regexp_extract(u, '^git@github\\.com:([^/]+)/(.+)\\.git$', 2) AS ssh_repo,
         lower(regexp_extract(u, '^[a-z]+://([^/:?#]+)', 1)) = 'github.com' AS on_host,
         string_split(trim(regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '/') AS path_parts
  FROM (SELECT *, {strip('url')} AS u FROM urls)),
answers AS (
  SELECT conv_id * 1000 + turn AS file_id, conv_id % 4 AS form, turn, text FROM conversations WHERE role = 'assistant')
"""


def _prompt(intro: str, tail: str) -> str:
    before, after = intro.split("{language}")
    quoted = tail.replace("'", "''")
    return (
        f"chr(10) || '{before}' || language || '{after}' || chr(10) || chr(10) || 'File: ' || path || chr(10) || chr(10) "
        f"|| '```' || language || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) || '{quoted}'"
    )


QUALITY_PROMPT = _prompt(*fv.QUALITY_TEMPLATE)
SECURITY_PROMPT = _prompt(*fv.SECURITY_TEMPLATE)
SUGGESTIONS_PROMPT = _prompt(*fv.SUGGESTIONS_TEMPLATE)


def _prompt_facts(prompt: str) -> str:
    return f"SELECT file_id, length(p)::INTEGER AS n_chars, sha256(p) AS prompt_hash FROM (SELECT file_id, {prompt} AS p FROM code_files)"


def _embedding(rows: str, key: str) -> str:
    """Word-hash weights per (key, bucket) of a source with key and text columns."""
    return f"""
  hashed AS (SELECT {key}, {bucket('w')} AS bucket, count(*) AS n FROM (
      SELECT {key}, unnest(regexp_split_to_array(lower(text), '{SPACE}+')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL),
  weights AS (SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w FROM hashed)"""


def _block_pairs(blocks: str) -> str:
    """Similar pairs and metrics per file of a source with file_id, block_no and block."""
    return f""",
block_words AS (
  SELECT file_id, block_no, {bucket('w')} AS bucket, count(*)::BIGINT AS n FROM (
    SELECT file_id, block_no, unnest(regexp_split_to_array(lower(block), '{SPACE}+')) AS w FROM {blocks})
  WHERE w <> '' GROUP BY ALL),
block_norms AS (SELECT file_id, block_no, sum(n * n)::BIGINT AS q FROM block_words GROUP BY ALL),
block_pairs AS (
  SELECT file_id, i, j, round(d / sqrt((qa * qb)::DOUBLE), 6) AS score FROM (
    SELECT a.file_id, a.block_no AS i, b.block_no AS j, sum(a.n * b.n)::BIGINT AS d
    FROM block_words a JOIN block_words b ON a.file_id = b.file_id AND a.bucket = b.bucket AND a.block_no < b.block_no
    GROUP BY ALL) p
  JOIN (SELECT file_id, block_no AS i, q AS qa FROM block_norms) USING (file_id, i)
  JOIN (SELECT file_id, block_no AS j, q AS qb FROM block_norms) USING (file_id, j)
  WHERE round(d / sqrt((qa * qb)::DOUBLE), 6) >= 0.7),
block_metrics AS (
  SELECT file_id, total_blocks, coalesce(n, 0) AS n, coalesce(best, 0.0) AS best, coalesce(mean, 0.0) AS mean,
         least(1.0, coalesce(n, 0) / greatest(1.0, total_blocks * (total_blocks - 1) / 2.0)) AS share
  FROM (SELECT f.file_id, count(b.block_no) AS total_blocks FROM files_v f LEFT JOIN {blocks} b USING (file_id) GROUP BY ALL)
  LEFT JOIN (SELECT file_id, count(*) AS n, max(score) AS best, avg(score) AS mean FROM block_pairs GROUP BY ALL) USING (file_id))
"""

BLOCK_PAIRS = _block_pairs("blocks")
PARAGRAPHS = "(SELECT file_id, (line_no - 1)::INTEGER AS block_no, raw AS block FROM file_lines WHERE raw <> '')"

SERVED = """
served_summary AS (
  SELECT a.id AS pr_analysis_id, coalesce(nullif(a.total_files, 0), f.n, 0) AS total_files,
         coalesce(nullif(a.total_issues, 0), i.n, 0) AS total_issues, coalesce(added, 0) AS total_lines_added,
         coalesce(removed, 0) AS total_lines_removed, coalesce(critical, 0) AS critical_issues, coalesce(high, 0) AS high_issues,
         coalesce(medium, 0) AS medium_issues, coalesce(low, 0) AS low_issues, coalesce(languages, '') AS languages_detected,
         a.quality_score AS overall_score
  FROM analyses a
  LEFT JOIN (SELECT pr_analysis_id AS id, count(*) AS n, sum(coalesce(lines_added, 0))::BIGINT AS added,
                    sum(coalesce(lines_removed, 0))::BIGINT AS removed,
                    array_to_string(list_sort(list_distinct(list(nullif(file_type, '')))), ',') AS languages
             FROM file_rows GROUP BY 1) f USING (id)
  LEFT JOIN (SELECT pr_analysis_id AS id, count(*) AS n, count(*) FILTER (level = 'critical') AS critical,
                    count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium,
                    count(*) FILTER (level = 'low') AS low FROM stored_issues GROUP BY 1) i USING (id))
"""

TASK_STATE = """
  SELECT task_id, CASE WHEN last = 'retry' AND retries > 3 THEN 'failed' ELSE coalesce(last, 'pending') END AS status,
         retries AS retry_count, coalesce(progress, 0) AS progress, epoch_us(started) AS started_at,
         epoch_us(ended) AS completed_at, error_message
  FROM (SELECT task_id, arg_max(state, (ts, seq)) FILTER (state IS NOT NULL) AS last,
               count(*) FILTER (state = 'retry') AS retries,
               arg_max(stored, (ts, seq)) FILTER (stored IS NOT NULL) AS progress,
               max(ts) FILTER (state = 'processing') AS started,
               max(ts) FILTER (state IN ('completed', 'failed')) AS ended,
               arg_max(coalesce(message, '<none>'), (ts, seq)) FILTER (state = 'failed') AS error_raw,
               nullif(error_raw, '<none>') AS error_message
        FROM event_progress GROUP BY task_id)
"""

STATUS = """
  SELECT task_id, coalesce(arg_max(state, (ts, seq)) FILTER (state IS NOT NULL), 'pending') AS status,
         arg_max(progress, (ts, seq)) FILTER (progress IS NOT NULL) AS progress,
         nullif(arg_max(coalesce(message, '<none>'), (ts, seq)) FILTER (state = 'failed'), '<none>') AS error_message
  FROM task_events GROUP BY task_id
"""

LIVE = """
, changes AS (
  SELECT id, created_at AS changed, 'pending' AS status, NULL AS error_message FROM tasks
  UNION ALL SELECT id, coalesce(completed_at, created_at), status, CASE WHEN status = 'failed' THEN 'failed at ' || id END FROM tasks),
newest AS (
  SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000000 END AS task_id, status, error_message, epoch_us(changed) AS updated_at FROM changes
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY changed DESC, status IN ('completed', 'failed', 'cancelled') DESC, status DESC) = 1),
told AS (
  SELECT task_id, progress, stage, epoch_us(ts) AS reported_at FROM task_events WHERE progress IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, seq DESC) = 1)
SELECT task_id, n.task_id IS NOT NULL AS known, status, error_message, updated_at, progress, stage, reported_at
FROM newest n FULL JOIN told t USING (task_id)
"""

LENIENT = """
  SELECT url_id, CASE WHEN is_ssh THEN ssh_owner WHEN on_host AND len(path_parts) >= 2 THEN path_parts[1] END AS owner,
         CASE WHEN is_ssh THEN ssh_repo WHEN on_host AND len(path_parts) >= 2
              THEN regexp_replace(path_parts[2], '\\.git$', '') END AS repo
  FROM url_parts
"""

STATISTICS = """
SELECT coalesce(f.p, i.p) AS pr_analysis_id, coalesce(n, 0) AS total_files_analyzed, coalesce(lines, 0) AS total_lines_analyzed,
       coalesce(total, 0) AS total_issues_found, coalesce(critical, 0) AS critical_issues, coalesce(high, 0) AS high_issues,
       coalesce(medium, 0) AS medium_issues, coalesce(low, 0) AS low_issues, coalesce(info, 0) AS info_issues
FROM (SELECT pr_analysis_id AS p, count(*) AS n, sum(lines_analyzed)::BIGINT AS lines FROM file_rows GROUP BY 1) f
FULL JOIN (SELECT pr_analysis_id AS p, count(*) AS total, count(*) FILTER (level = 'critical') AS critical,
                  count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium,
                  count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'info') AS info
           FROM stored_issues GROUP BY 1) i ON f.p = i.p"""

# What is left of the stored tables once low-priority tasks are deleted and every third review is stored anew without low issues.
KEPT = """
, kept_reviews AS (SELECT id FROM tasks WHERE priority <> 'low' OR id % 3 = 0),
kept_analyses AS (SELECT * FROM all_analyses SEMI JOIN kept_reviews USING (id)),
kept_files AS (SELECT * FROM file_rows WHERE pr_analysis_id IN (SELECT id FROM kept_reviews)),
kept_issues AS (SELECT * FROM stored_issues WHERE pr_analysis_id IN (SELECT id FROM kept_reviews) AND (pr_analysis_id % 3 <> 0 OR level <> 'low'))
"""


def _kept(question: str) -> str:
    for stored, left in (("file_rows", "kept_files"), ("stored_issues", "kept_issues"), ("analyses a", "kept_analyses a")):
        question = question.replace(f"FROM {stored}", f"FROM {left}")
    return question


ORACLE: dict[str, str] = {
    "s01_pull_requests": """
SELECT doc_id AS pr_id, 'team' AS repo_owner, source AS repo_name, (doc_id + 1)::INTEGER AS number, 'Change ' || doc_id AS title,
       source AS author, 'topic/' || lang AS head_ref, 'main' AS base_ref,
       (CASE WHEN doc_id % 5 <> 0 THEN doc_id % 30 ELSE 0 END)::INTEGER AS changed_files,
       (n_chars % 40)::INTEGER AS additions, (n_chars % 13)::INTEGER AS deletions FROM documents""",
    "s02_pr_files": """
SELECT pr_id::VARCHAR AS pr_id, ((page - 1) * 8 + row_number() OVER (PARTITION BY pr_id, page ORDER BY file_id) - 1)::INTEGER AS file_index,
       path AS filename, status, additions::INTEGER AS additions
FROM (SELECT *, (CASE WHEN file_id % 41 < 20 THEN file_id % 41 ELSE file_id % 41 - 20 END) // 8 + 1 AS page FROM files_v)""",
    "s02b_whole_listings": """
, placed AS (SELECT pr_id, path, (CASE WHEN file_id % 41 < 20 THEN file_id % 41 ELSE file_id % 41 - 20 END) // 8 + 1 AS page, file_id FROM files_v),
listed AS (SELECT *, (page - 1) * 8 + row_number() OVER (PARTITION BY pr_id, page ORDER BY file_id) - 1 AS place FROM placed),
declared AS (SELECT pr_id, count(*) + CASE WHEN pr_id % 7 = 3 THEN 1 ELSE 0 END AS changed_files FROM listed GROUP BY pr_id),
landed AS (SELECT pr_id, page, count(*) AS n FROM listed
           WHERE NOT (pr_id % 7 = 1 AND page = 1) AND NOT (pr_id % 7 = 2 AND page = 3) GROUP BY ALL),
judged AS (
  SELECT pr_id, concat_ws(',', CASE WHEN n IS NULL THEN 'no pages' END, CASE WHEN pages < last_page THEN 'missing pages' END,
                   CASE WHEN short - CASE WHEN last_n < 8 THEN 1 ELSE 0 END > 0 THEN 'short pages' END,
                   CASE WHEN last_n = 8 AND n <> changed_files THEN 'no last page' END,
                   CASE WHEN n <> changed_files THEN 'other number of files' END) AS found
  FROM declared LEFT JOIN (SELECT pr_id, sum(n) AS n, count(*) AS pages, max(page) AS last_page, arg_max(n, page) AS last_n,
                                  count(*) FILTER (n < 8) AS short FROM landed GROUP BY pr_id) USING (pr_id))
SELECT pr_id::VARCHAR AS pr_id, place::BIGINT AS place, path AS found FROM listed JOIN judged USING (pr_id) WHERE judged.found = ''
UNION ALL SELECT pr_id::VARCHAR, -1, found FROM judged WHERE found <> ''""",
    "s03_file_content": """
SELECT doc_id::VARCHAR AS filename, sha256(c) AS content_hash, length(c)::INTEGER AS n_chars
FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN '' ELSE text END AS c FROM documents)""",
    "s04_repository_dimension": """
SELECT doc_id, source AS repo_name, language, (CASE WHEN n % 2 = 0 THEN n ELSE 0 END)::INTEGER AS stars
FROM documents JOIN (SELECT source, max(lang) AS language, max(n_chars) AS n FROM documents GROUP BY source) USING (source)""",
    "s05_content_selection": """
SELECT file_id, sha256(CASE file_id % 3 WHEN 1 THEN '' WHEN 2 THEN content ELSE patch END) AS content_hash, additions, deletions
FROM patched""",
    "s06_result_sink": """
SELECT id, CASE status WHEN 'processing' THEN 'completed' ELSE status END AS status,
       CASE status WHEN 'processing' THEN 100 ELSE 30 END AS progress,
       epoch_us(CASE status WHEN 'processing' THEN created_at + to_minutes(5) ELSE completed_at END) AS completed_us FROM tasks""",
    "s06b_review_run": """
SELECT pr_id, count(*) AS total_files_analyzed, sum(n)::BIGINT AS total_issues_found, sum(critical)::BIGINT AS critical_issues,
       sum(code_lines)::BIGINT AS total_lines_analyzed, sum(high)::BIGINT AS high_issues, sum(medium)::BIGINT AS medium_issues,
       sum(n - critical - high - medium)::BIGINT AS low_issues, trunc(avg(quality))::DOUBLE AS quality_score
FROM scored JOIN (SELECT file_id, high, medium FROM counts) USING (file_id) GROUP BY pr_id""",
    "s06c_snapshots": """
, whole AS (SELECT 'pr_analyses' AS table_name, count(*) AS n FROM all_analyses UNION ALL SELECT 'file_analyses', count(*) FROM file_rows
            UNION ALL SELECT 'issues', count(*) FROM stored_issues)
SELECT 'interrupted' AS moment, * FROM whole UNION ALL SELECT 'as of the first', * FROM whole
UNION ALL SELECT 'committed', * FROM whole WHERE table_name <> 'issues'
UNION ALL SELECT 'committed', 'issues', count(*) FROM stored_issues WHERE pr_analysis_id % 3 <> 0 OR level <> 'low'""",
    "s07_cascade_delete": """
, kept AS (SELECT id FROM tasks WHERE priority <> 'low')
SELECT 'tasks' AS table_name, id AS parent, count(*) AS n FROM kept GROUP BY id
UNION ALL SELECT 'pr_analyses', id, count(*) FROM all_analyses SEMI JOIN kept USING (id) GROUP BY id
UNION ALL SELECT 'file_analyses', pr_analysis_id, count(*) FROM file_rows
  WHERE pr_analysis_id NOT IN (SELECT id FROM all_analyses WHERE id NOT IN (SELECT id FROM kept)) GROUP BY ALL
UNION ALL SELECT 'issues', pr_analysis_id, count(*) FROM stored_issues
  WHERE pr_analysis_id NOT IN (SELECT id FROM all_analyses WHERE id NOT IN (SELECT id FROM kept)) GROUP BY ALL""",
    "s08_webhook_stream": f"""
, lenient AS ({LENIENT})
SELECT CASE WHEN url_id % 3 = 0 THEN 'opened' ELSE 'synchronize' END AS action, (url_id % 9)::INTEGER AS pr_number,
       't' || url_id AS title, CASE WHEN reasons = '' THEN owner END AS repo_owner, CASE WHEN reasons = '' THEN repo END AS repo_name,
       CASE WHEN reasons = '' THEN 'normal' END AS priority, reasons
FROM lenient JOIN (SELECT url_id, concat_ws(',', CASE WHEN NOT (is_https OR is_ssh) THEN 'repo_url' END,
                                            CASE WHEN url_id % 9 = 0 THEN 'pr_number' END) AS reasons FROM url_parts) USING (url_id)""",
    "f01_repo_url": """
SELECT url_id, is_https OR is_ssh AS valid,
       CASE WHEN is_https THEN path_parts[1] WHEN is_ssh THEN ssh_owner END AS owner,
       CASE WHEN is_https THEN path_parts[2] WHEN is_ssh THEN ssh_repo END AS repo FROM url_parts""",
    "f01b_repo_url_lenient": LENIENT,
    "f02_request_validation": f"""
, lenient AS ({LENIENT}),
asked AS (SELECT url_id, is_https OR is_ssh AS ok, url_id % 6 - 1 AS pr_number,
                 CASE WHEN url_id % 7 <> 0 THEN ['low', 'normal', 'high', 'urgent', 'asap'][url_id % 5 + 1] END AS priority FROM url_parts),
judged AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT ok THEN 'repo_url' END, CASE WHEN pr_number <= 0 THEN 'pr_number' END,
                 CASE WHEN priority = 'asap' THEN 'priority' END], lambda x: x IS NOT NULL), ',') AS reasons FROM asked)
SELECT url_id, reasons, CASE WHEN reasons = '' THEN coalesce(priority, 'normal') ELSE priority END AS priority,
       CASE WHEN reasons = '' THEN owner END AS repo_owner, CASE WHEN reasons = '' THEN repo END AS repo_name
FROM judged JOIN lenient USING (url_id)""",
    "f02b_record_validation": """
SELECT event_id, array_to_string(list_filter([
  CASE WHEN trunc(value) NOT BETWEEN 0 AND 100 THEN 'progress' END, CASE WHEN value / 100 NOT BETWEEN 0 AND 1 THEN 'confidence' END,
  CASE WHEN value - 5 < 0 THEN 'complexity_score' END,
  CASE WHEN event_id % 4 <> 0 AND value * 2 NOT BETWEEN 0 AND 100 THEN 'overall_score' END,
  CASE WHEN trunc(value) + 1 NOT BETWEEN 1 AND 200 THEN 'max_issues_per_file' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM events""",
    "f03_file_name_parts": """
SELECT page_id, split_part(url, '/', -1) AS file_name, CASE WHEN contains(url, '.') THEN split_part(url, '.', -1) END AS file_extension
FROM pages""",
    "f04_language": f"SELECT file_id, {LANGUAGE} AS language FROM files_v",
    "f05_issue_type": f"SELECT issue_id, type, {ISSUE_TYPE} AS issue_type FROM raw_issues",
    "f06_severity": f"SELECT issue_id, {SEVERITY} AS level, ({RANK.format(SEVERITY)})::INTEGER AS sev_rank FROM raw_issues",
    "f07_issue_projection": """
SELECT id, title, description, line_number, column_number, rule_id, suggestion, confidence, 0 AS n_tags FROM stored_issues""",
    "f08_lifecycle_predicates": """
SELECT id, status IN ('completed', 'failed', 'cancelled') AS is_completed, status = 'processing' AS is_running,
       status = 'failed' AND retry_count < 3 AS can_retry FROM tasks""",
    "f08b_analysis_predicates": """
SELECT a.id, true AS is_completed, coalesce(n, 0) > 0 AS has_critical_issues FROM all_analyses a
LEFT JOIN (SELECT pr_analysis_id AS id, count(*) AS n FROM stored_issues WHERE level = 'critical' GROUP BY 1) USING (id)""",
    "f09_duration": "SELECT id, (epoch_us(completed_at) - epoch_us(started_at)) / 1e6 AS seconds FROM tasks",
    "f10_location": """
SELECT issue_id, CASE WHEN loc = '' THEN 'unknown location' ELSE loc END AS location FROM (
  SELECT issue_id, concat_ws(':', CASE WHEN line % 3 <> 0 THEN file_id END, CASE WHEN line > 2 THEN 'line ' || line END,
         CASE WHEN line > 2 AND col <> 0 THEN 'column ' || col END) AS loc FROM raw_issues)""",
    "f11_config_filter": f"""
SELECT i.id, i.issue_type, i.level AS severity FROM stored_issues i LEFT JOIN orders ON o_orderkey = i.pr_analysis_id
WHERE (issue_type <> 'style' OR coalesce(o_orderkey % 2 = 0, true)) AND (issue_type <> 'security' OR coalesce(o_orderkey % 3 <> 0, true))
  AND (issue_type <> 'performance' OR coalesce(o_orderkey % 5 <> 0, true))
  AND (issue_type <> 'best_practice' OR coalesce(o_orderkey % 7 <> 0, true))
  AND {RANK.format('level')} >= (CASE WHEN o_orderkey % 4 <> 0 THEN [0, 1, 3][o_orderkey % 3 + 1] ELSE 1 END)""",
    "f12_completed_gate": """
SELECT t.id, CASE WHEN status <> 'completed' THEN 'task_not_completed' WHEN a.id IS NULL THEN 'no_analysis' ELSE 'served' END AS outcome
FROM tasks t LEFT JOIN analyses a USING (id)""",
    "f13_default_metrics": """
SELECT f.file_id, coalesce(complexity, 5) AS complexity_score, coalesce(maintainability, 75) AS maintainability_score,
       'unknown' AS language, coalesce(total_lines, 0) AS total_lines, coalesce(code_lines, 0) AS code_lines,
       round(coalesce(duplication, 0.0), 6) AS duplication_score
FROM files_v f LEFT JOIN (SELECT * FROM plain_metrics SEMI JOIN (SELECT doc_id AS file_id FROM labels) USING (file_id)) USING (file_id)""",
    "t01_line_table": "SELECT file_id, line_no::INTEGER AS line_no, raw AS line FROM file_lines",
    "t02_nonblank_lines": f"""
SELECT file_id, count(*)::INTEGER AS n, sha256(string_agg({strip('line')}, {NL} ORDER BY line_no)) AS lines_hash
FROM code_lines WHERE {strip('line')} <> '' GROUP BY file_id""",
    "t03_code_text": f"""
SELECT file_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_hash, t AS code_text
FROM (SELECT file_id, string_agg({strip('line')}, ' ' ORDER BY line_no) AS t FROM code_lines WHERE {strip('line')} <> '' GROUP BY file_id)""",
    "t04_keyword_complexity": "SELECT file_id, complexity FROM metrics",
    "t05_duplicate_line_ratio": "SELECT file_id, round(duplication, 9) AS duplication FROM plain_metrics",
    "t06_maintainability": "SELECT file_id, maintainability AS maintainability_score FROM metrics",
    "t07_security_scan": """
SELECT file_id, line::INTEGER AS line, type, severity FROM findings WHERE starts_with(rule_id, 'security.')""",
    "t08_python_lint": """
SELECT file_id, line::INTEGER AS line, type, severity, message FROM findings WHERE starts_with(rule_id, 'python.')""",
    "t09_script_lint": """
SELECT file_id, line::INTEGER AS line, type, severity, message FROM findings WHERE starts_with(rule_id, 'script.')""",
    "t10_language_lint": """
SELECT file_id, line::INTEGER AS line, rule_id, suggestion FROM findings WHERE NOT starts_with(rule_id, 'security.')""",
    "t11_python_suggestions": """
SELECT file_id, 'import' AS type, 'medium' AS priority, 'Avoid wildcard imports' AS message FROM code_files
WHERE language = 'python' AND contains(content, 'import *')
UNION ALL SELECT file_id, 'exception_handling', 'high', 'Use specific exception types' FROM code_files
WHERE language = 'python' AND contains(content, 'except:') AND NOT contains(content, 'except Exception:')""",
    "t12_script_suggestions": """
SELECT file_id, 'comparison' AS type, 'medium' AS priority, 'Use strict equality' AS message FROM code_files
WHERE language IN ('javascript', 'typescript') AND contains(content, '==') AND NOT contains(content, '===')""",
    "t13_function_lengths": "SELECT file_id, function_name, length FROM function_table",
    "t14_long_functions": """
SELECT file_id, function_name, 'Function ''' || function_name || ''' is too long (' || length || ' lines)' AS message
FROM function_table WHERE length > 50""",
    "t15_threshold_flags": """
SELECT file_id, coalesce(longest, 0) > 50 AS long_function, total_lines > 500 AS long_file, complexity > 10 AS high_complexity,
       duplication > 0.3 AS high_duplication
FROM metrics LEFT JOIN (SELECT file_id, max(length) AS longest FROM function_table GROUP BY 1) USING (file_id)""",
    "t16_best_practices": f"""
SELECT file_id, 0 AS line, 'python.import.' || name AS rule_id, 'Missing import: ' || name AS message
FROM code_files, (SELECT unnest(['typing', 'logging']) AS name) WHERE language = 'python'
  AND NOT regexp_matches(content, '(^|\\n){SPACE}*(import|from){SPACE}+' || name || '($|[^\\p{{L}}\\p{{N}}_])')
UNION ALL SELECT file_id, 0, language || '.wanted.' || word, 'Expected to use: ' || word FROM code_files JOIN (
    SELECT 'javascript' AS language, unnest(['const', 'let']) AS word
    UNION ALL SELECT 'typescript', unnest(['interface', 'type'])) USING (language) WHERE NOT contains(content, word)
UNION ALL SELECT file_id, line_no::INTEGER, 'javascript.unwanted.var', 'Avoid: var' FROM lang_lines
  WHERE language = 'javascript' AND regexp_matches(line, '(^|[^\\p{{L}}\\p{{N}}_])var{SPACE}+')
UNION ALL SELECT file_id, line_no::INTEGER, language || '.line_limit', 'Line longer than ' || lim FROM lang_lines JOIN (
    SELECT 'python' AS language, 88 AS lim UNION ALL SELECT 'javascript', 100 UNION ALL SELECT 'typescript', 100) USING (language)
  WHERE length(line) > lim
UNION ALL SELECT file_id, line_no::INTEGER, 'python.naming', 'Name is not snake_case: ' || regexp_extract(line, '{DEF_NAME}', 1) FROM lang_lines
  WHERE language = 'python' AND regexp_extract(line, '{DEF_NAME}', 1) <> ''
    AND NOT regexp_matches(regexp_extract(line, '{DEF_NAME}', 1), '^[a-z_][a-z0-9_]*$')""",
    "t17_content_hash": """
SELECT sha256(content) AS content_hash, min(file_id) AS first_file_id, count(*) AS copies FROM files_v GROUP BY content""",
    "t17b_content_changes": """
SELECT path, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN file_id % 7 = 0 THEN 'changed' ELSE 'same' END AS change
FROM files_v LEFT JOIN labels l ON l.doc_id = file_id""",
    "t18_summary_line": """
SELECT file_id, concat_ws(' | ', '**' || split_part(path, '/', -1) || '** (' || language || ')',
    'Maintainability: ' || round_even(maintainability - 0.5, 0)::BIGINT || '/100',
    CASE WHEN grave > 0 THEN '⚠️ ' || grave || ' critical issues' WHEN n > 0 THEN n || ' issues found' ELSE '✅ No issues found' END,
    CASE WHEN additions <> 0 AND deletions <> 0 THEN '+' || additions || '/-' || deletions || ' lines' END) AS summary
FROM scored""",
    "t19_word_jaccard": f"""
, sets AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE
    len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE END, 9) AS similarity
FROM sets a JOIN sets b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "t19b_similar_documents": f"""
, entries AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> ''))) AS w FROM documents),
sets AS (SELECT w, min(doc_id) AS first_id, count(*) AS copies FROM entries GROUP BY w),
tokens AS (SELECT first_id, len(w) AS n, unnest(w) AS word FROM sets),
pairs AS (SELECT a.first_id AS id_a, b.first_id AS id_b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS total
    FROM tokens a JOIN tokens b ON a.word = b.word AND a.first_id < b.first_id GROUP BY 1, 2 HAVING 100 * common >= 80 * total),
links AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reached AS (SELECT * FROM (WITH RECURSIVE r(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.other) SELECT * FROM r)),
classes AS (SELECT id, least(id, min(other)) AS class_id FROM reached GROUP BY id),
met AS (SELECT l.a AS id, sum(s.copies) AS others FROM links l JOIN sets s ON s.first_id = l.b GROUP BY l.a)
SELECT e.doc_id, s.first_id, coalesce(c.class_id, s.first_id) AS class_id, (s.copies - 1 + coalesce(m.others, 0))::BIGINT AS n_links
FROM entries e JOIN sets s ON s.w = e.w LEFT JOIN classes c ON c.id = s.first_id LEFT JOIN met m ON m.id = s.first_id""",
    "t19c_similar_pairs": f"""
, entries AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> ''))) AS w FROM documents),
sets AS (SELECT w, min(doc_id) AS first_id, count(*) AS copies FROM entries GROUP BY w),
tokens AS (SELECT first_id, len(w) AS n, unnest(w) AS word FROM sets),
pairs AS (SELECT a.first_id AS id_a, b.first_id AS id_b, count(*) AS common, any_value(a.n) + any_value(b.n) - count(*) AS total
    FROM tokens a JOIN tokens b ON a.word = b.word AND a.first_id < b.first_id GROUP BY 1, 2 HAVING 100 * common >= 80 * total)
SELECT id_a, id_b, round(common / total::DOUBLE, 9) AS similarity FROM pairs""",
    "d01_patch_lines": "SELECT file_id, line_no::INTEGER AS line_no, kind FROM patch_kinds",
    "d02_symbol_names": "SELECT file_id, line_no::INTEGER AS line_no, symbol FROM patch_kinds",
    "d03_affected_functions": "SELECT file_id, array_to_string(functions, ',') AS affected_functions FROM impact",
    "d04_impact_score": "SELECT file_id, impact_score FROM impact_scores",
    "d05_risk_level": "SELECT file_id, risk_level FROM risks",
    "d06_change_type": "SELECT file_id, change_type FROM change_types",
    "d07_diff_impact": """
SELECT file_id, impact_score, risk_level, CASE WHEN patch = '' THEN 'no_changes' ELSE change_type END AS change_type,
       array_to_string(functions, ',') AS affected_functions, lines_added, lines_removed, lines_added - lines_removed AS net_lines
FROM risks JOIN change_types USING (file_id)""",
    "e01_text_embedding": f"""
, {_embedding("(SELECT doc_id AS file_id, text FROM documents)", "file_id")}
SELECT file_id, bucket, round(w, 6) AS weight FROM weights""",
    "e02_batch_embedding": f"""
, {_embedding("benchmark", "item_id")}
SELECT item_id, bucket, round(w, 6) AS weight FROM weights""",
    "e03_cosine": """
SELECT a.vec_id, round(greatest(0.0, least(1.0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 5) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "e04_similar_code": f"""
, texts AS (SELECT doc_id * 2 AS k, text FROM documents UNION ALL SELECT item_id * 2 + 1, text FROM benchmark),
{_embedding("texts", "k")},
pairs AS (SELECT (t.k - 1) // 2 AS item_id, c.k // 2 AS doc_id, round(sum(t.w * c.w), 6) AS score
          FROM weights t JOIN weights c USING (bucket) WHERE t.k % 2 = 1 AND c.k % 2 = 0 GROUP BY ALL)
SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE score >= 0.4)
WHERE rank <= 5""",
    "e04b_index_search": """
, target_scores AS (SELECT t.vec_id AS target_id, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score
             FROM embeddings t JOIN embeddings e ON t.vec_id % 50 = 0),
target_ranks AS (SELECT *, (row_number() OVER (PARTITION BY target_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM target_scores WHERE score >= 0.2)
SELECT target_id, vec_id, score, rank FROM target_ranks WHERE rank <= 5""",
    "e05_duplicate_pairs": """
, groups AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS v, count(*) AS n FROM embeddings GROUP BY embedding)
SELECT a.id AS id_a, b.id AS id_b, round(list_dot_product(a.v, b.v), 6) AS score, a.n * b.n AS n_pairs
FROM groups a JOIN groups b ON a.id < b.id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.3
UNION ALL SELECT id, id, round(list_dot_product(v, v), 6), n * (n - 1) // 2 FROM groups WHERE n > 1""",
    "e05b_duplicates_in_key": """
, groups AS (SELECT label, min(vec_id) AS id, embedding::DOUBLE[] AS v, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label, embedding)
SELECT a.label, a.id AS id_a, b.id AS id_b, round(list_dot_product(a.v, b.v), 6) AS score, a.n * b.n AS n_pairs
FROM groups a JOIN groups b ON a.label = b.label AND a.id < b.id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.3
UNION ALL SELECT label, id, id, round(list_dot_product(v, v), 6), n * (n - 1) // 2 FROM groups WHERE n > 1""",
    "e05c_duplicate_classes": """
, groups AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS v, count(*) AS n FROM embeddings GROUP BY embedding),
links AS (SELECT a.id AS a, b.id AS b, b.n FROM groups a JOIN groups b ON a.id <> b.id WHERE round(list_dot_product(a.v, b.v), 6) >= 0.3),
reached AS (SELECT * FROM (WITH RECURSIVE r(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.other) SELECT * FROM r)),
classes AS (SELECT id, least(id, min(other)) AS class_id FROM reached GROUP BY id),
counted AS (SELECT g.id, g.v, coalesce(class_id, g.id) AS class_id, g.n - 1 + coalesce(m.n, 0) AS n_links
            FROM groups g LEFT JOIN classes c USING (id) LEFT JOIN (SELECT a AS id, sum(n)::BIGINT AS n FROM links GROUP BY a) m ON m.id = g.id)
SELECT e.vec_id, g.id AS first_id, g.class_id, g.n_links FROM embeddings e JOIN counted g ON e.embedding::DOUBLE[] = g.v WHERE n_links > 0""",
    "e06_code_blocks": "SELECT file_id, block_no, block FROM blocks",
    "e07_block_similarity": BLOCK_PAIRS + """
SELECT file_id, total_blocks, n AS duplicates_found, best AS max_similarity, round(mean, 9) AS avg_similarity,
       round(share, 6) AS duplication_score FROM block_metrics""",
    "j01_result_documents": f"""
, {SERVED},
parts AS (SELECT f.pr_analysis_id, f.id, f.id || '[' || coalesce(string_agg(i.id, ',' ORDER BY i.id), '') || ']' AS doc
          FROM file_rows f LEFT JOIN stored_issues i ON i.file_analysis_id = f.id GROUP BY f.pr_analysis_id, f.id)
SELECT t.id AS task_id, t.repo_url AS github_repo, 0::BIGINT AS page, 1::BIGINT AS pages,
       coalesce(string_agg(doc, ';' ORDER BY p.id), '') AS files, any_value(total_issues) AS total_issues
FROM tasks t JOIN served_summary s ON s.pr_analysis_id = t.id LEFT JOIN parts p ON p.pr_analysis_id = t.id
WHERE t.status = 'completed' GROUP BY t.id, t.repo_url""",
    "j02_task_lookup": """
SELECT w.id, coalesce(t.status, 'not found') AS status FROM (SELECT DISTINCT user_id * 211 AS id FROM events) w LEFT JOIN tasks t USING (id)""",
    "a01_analysis_statistics": STATISTICS,
    "a01b_kept_statistics": KEPT + _kept(STATISTICS),
    "a02_issue_counts": """
SELECT file_id, count(*) AS issues_count, count(*) FILTER (severity IN ('critical', 'high')) AS critical_issues_count
FROM raw_issues WHERE file_id IS NOT NULL GROUP BY 1""",
    "a03_quality_score": "SELECT file_id, quality::BIGINT AS quality_score FROM scored",
    "a04_security_score": "SELECT file_id, security::BIGINT AS security_score FROM scored",
    "a05_pr_summary": """
, rolled AS (SELECT pr_id, avg(quality) AS mean, count(*) AS files, sum(n)::BIGINT AS issues, sum(critical)::BIGINT AS critical,
                    sum(sec)::BIGINT AS security FROM scored GROUP BY 1)
SELECT pr_id, CASE WHEN critical > 0 THEN 'needs_work' WHEN mean >= 85 THEN 'excellent' WHEN mean >= 75 THEN 'good' ELSE 'fair' END AS overall_quality,
       trunc(mean)::BIGINT AS overall_score, files AS total_files_analyzed, issues AS total_issues, critical AS critical_issues,
       security AS security_issues,
       coalesce(nullif(concat_ws('|', CASE WHEN critical > 0 THEN 'Address ' || critical || ' critical security issues immediately' END,
         CASE WHEN mean < 70 THEN 'Consider refactoring to improve code quality' END,
         CASE WHEN files > 20 THEN 'Large PR - consider breaking into smaller changes' END), ''),
         'Code looks good! Consider adding tests if not present') AS recommendations,
       'PR ' || pr_id AS title, CASE WHEN pr_id % 3 <> 0 THEN 'dev' ELSE '' END AS author, files::INTEGER AS files_changed
FROM rolled""",
    "a06_served_summary": f", {SERVED.replace('FROM analyses a', 'FROM all_analyses a')} SELECT * FROM served_summary",
    "a06b_kept_summary": f"{KEPT}, {_kept(SERVED)} SELECT * FROM served_summary",
    "a07_job_results": """
SELECT p AS pr_id, total AS total_files, coalesce(done, 0) AS files_analyzed, coalesce(found, 0) AS total_issues, coalesce(critical, 0) AS critical_issues
FROM (SELECT l_orderkey AS p, count(*) AS total FROM lineitem GROUP BY 1)
LEFT JOIN (SELECT pr_analysis_id AS p, count(*) AS done FROM file_rows GROUP BY 1) USING (p)
LEFT JOIN (SELECT pr_id AS p, count(*) AS found, count(*) FILTER (lower(severity) = 'critical') AS critical FROM raw_issues GROUP BY 1) USING (p)""",
    "a08_file_headers": """
SELECT file_id, pr_id, path AS file_path, split_part(path, '/', -1) AS file_name, split_part(path, '.', -1) AS file_extension,
       language AS file_type, 'completed' AS analysis_status, total_lines::BIGINT AS lines_total, code_lines::BIGINT AS lines_analyzed,
       additions AS lines_added, deletions AS lines_removed, complexity::DOUBLE AS complexity_score,
       maintainability::DOUBLE AS maintainability_index, n AS issues_count, grave AS critical_issues_count,
       'ai_agent,code_analyzer' AS analysis_tools_used FROM scored""",
    "a09_model_usage": f"""
SELECT conv_id AS pr_id, role AS model,
       sum(length(text) + CASE WHEN turn % 2 = 0 THEN len(list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda x: x <> '')) ELSE 0 END)::BIGINT AS tokens_consumed,
       sum(turn * 0.5::DOUBLE) AS ai_duration, count(*) AS calls FROM conversations GROUP BY ALL""",
    "k02_top_block_pairs": BLOCK_PAIRS + """
SELECT file_id, rank::INTEGER AS rank, i, j, score FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, i, j) AS rank FROM block_pairs) WHERE rank <= 5""",
    "k03_issue_limit": f"""
SELECT pr_analysis_id, id, r::INTEGER AS issue_rank FROM (SELECT *, row_number() OVER (PARTITION BY pr_analysis_id
    ORDER BY {RANK.format('level')} DESC, line_number, rule_id, id) AS r FROM stored_issues) WHERE r <= 3""",
    "k04_task_pages": """
SELECT id, n AS total_items, ((r - 1) // 25 + 1)::BIGINT AS page, 25 AS per_page, ceil(n / 25.0)::BIGINT AS total_pages,
       (r - 1) // 25 + 1 < ceil(n / 25.0) AS has_next, r > 25 AS has_prev
FROM (SELECT id, count(*) OVER () AS n, row_number() OVER (ORDER BY list_position(['urgent', 'high', 'normal', 'low'], priority), id) AS r FROM tasks)""",
    "k04b_stored_pages": """
, ranked AS (SELECT id, count(*) OVER () AS n, row_number() OVER (ORDER BY list_position(['urgent', 'high', 'normal', 'low'], priority), id) AS r FROM tasks),
paged AS (SELECT id, ((r - 1) // 25 + 1)::BIGINT AS page, n AS total_items, ceil(n / 25.0)::BIGINT AS pages FROM ranked)
SELECT 'page' AS by, id, page, total_items, page < pages AS has_next FROM paged
JOIN (SELECT unnest([1, (max(pages) + 1) // 2, max(pages)]) AS page FROM paged) USING (page)
UNION ALL SELECT 'key', id, NULL, NULL, NULL FROM paged WHERE page = 2""",
    "u01_issue_concat": """
SELECT 'quality' AS source, type, count(*) AS n, count(*) AS n_lines FROM raw_issues GROUP BY type
UNION ALL SELECT 'security', type, count(*), 0 FROM raw_issues WHERE type = 'security' GROUP BY type""",
    "p01_quality_prompt": _prompt_facts(QUALITY_PROMPT),
    "p02_security_prompt": _prompt_facts(SECURITY_PROMPT),
    "p03_suggestions_prompt": _prompt_facts(SUGGESTIONS_PROMPT),
    "p04_request_table": "\nUNION ALL ".join(
        f"SELECT file_id, '{operation}' AS operation, '{system}' AS system, sha256({prompt}) AS prompt_hash, "
        f"{fv.TEMPERATURE}::DOUBLE AS temperature, {fv.MAX_TOKENS} AS max_tokens FROM code_files"
        for operation, system, prompt in (
            ("analyze_code_quality", fv.QUALITY_SYSTEM, QUALITY_PROMPT),
            ("analyze_security", fv.SECURITY_SYSTEM, SECURITY_PROMPT),
            ("generate_suggestions", fv.SUGGESTIONS_SYSTEM, SUGGESTIONS_PROMPT),
        )
    ),
    "p05_quality_answers": f"""
SELECT file_id, CASE form WHEN 2 THEN 'free_text' WHEN 3 THEN 'unavailable' ELSE 'model' END AS source,
       CASE form WHEN 0 THEN turn + 0.5::DOUBLE WHEN 2 THEN 7.5 WHEN 3 THEN 0.0 END AS score,
       CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_issues, CASE form WHEN 1 THEN 0 ELSE 1 END AS n_suggestions,
       CASE WHEN form < 2 THEN (turn + 1)::INTEGER END AS first_line, CASE WHEN form < 2 THEN text END AS first_message,
       CASE WHEN form IN (0, 2) THEN text WHEN form = 3 THEN '{fv.UNAVAILABLE_SUGGESTION["description"]}' END AS first_suggestion,
       CASE form WHEN 0 THEN 4.0::DOUBLE WHEN 2 THEN 8.0 WHEN 3 THEN 0.0 END AS maintainability,
       CASE form WHEN 0 THEN 5.0::DOUBLE WHEN 2 THEN 7.0 WHEN 3 THEN 0.0 END AS readability FROM answers""",
    "p06_issue_answers": """
SELECT file_id, 'model' AS source, CASE form WHEN 1 THEN 'xss' END AS raw_type, 'bug' AS issue_type,
       CASE form WHEN 1 THEN 'high' ELSE 'low' END AS severity, CASE form WHEN 1 THEN text ELSE 'Unknown issue' END AS title,
       CASE form WHEN 1 THEN text ELSE '' END AS description, (CASE form WHEN 1 THEN turn + 1 ELSE 0 END)::INTEGER AS line_number,
       CASE form WHEN 1 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence FROM answers WHERE form < 2
UNION ALL SELECT file_id, 'free_text', 'info', 'style', 'medium', 'Security Analysis', text, 1, 0.5 FROM answers WHERE form = 2""",
    "p06b_suggestion_answers": """
SELECT file_id, 'model' AS source, CASE form WHEN 1 THEN 'xss' END AS type, NULL::VARCHAR AS priority, NULL::VARCHAR AS title,
       NULL::VARCHAR AS description, CASE form WHEN 1 THEN (turn + 1)::INTEGER END AS line FROM answers WHERE form < 2
UNION ALL SELECT file_id, 'free_text', 'improvement', 'medium', 'Code Improvement', text, 1 FROM answers WHERE form = 2""",
    "p07_unavailable_defaults": """
SELECT file_id, 0.0::DOUBLE AS score, 0 AS n_issues, 'AI Service Not Configured' AS suggestion, 0.0::DOUBLE AS complexity FROM answers WHERE form = 3""",
    "p08_metric_merge": BLOCK_PAIRS + """
SELECT a.file_id // 1000 AS file_id, CASE form WHEN 0 THEN turn + 0.5::DOUBLE WHEN 2 THEN 7.5 WHEN 3 THEN 0.0 END AS score,
       coalesce(n, 0) AS semantic_duplicates, coalesce(round(share, 6), 0) AS duplication_score,
       coalesce(total_blocks, 0) AS code_blocks_analyzed
FROM answers a LEFT JOIN block_metrics b ON b.file_id = a.file_id // 1000""",
    "r01_latest_status": STATUS,
    "r01b_latest_status_stream": STATUS,
    "r01c_live_status": LIVE,
    "r01d_live_status_stream": LIVE,
    "r02_progress_fold": """
SELECT task_id, coalesce(arg_max(stored, (ts, seq)) FILTER (stored IS NOT NULL), 0) AS progress,
       count(*) FILTER (message IS NOT NULL AND progress IS NOT NULL) AS log_entries FROM event_progress GROUP BY task_id""",
    "r02b_progress_log": """
SELECT task_id, epoch_us(ts) AS ts, seq, progress, message FROM task_events WHERE message IS NOT NULL AND progress IS NOT NULL""",
    "r03_task_fold": TASK_STATE,
    "r03b_task_fold_stream": TASK_STATE,
    "r04_stage_progress": """
, placed AS (SELECT pr_id, path, row_number() OVER (PARTITION BY pr_id ORDER BY file_id) AS i, count(*) OVER (PARTITION BY pr_id) AS n FROM files_v)
SELECT pr_id, (30 + trunc((i - 1)::DOUBLE / n * 50))::INTEGER AS progress, 'analyzing_files' AS stage,
       'Analyzing file ' || i || '/' || n || ': ' || path AS message FROM placed
UNION ALL SELECT pr_id, p, s, replace(m, '#', n::VARCHAR) FROM (SELECT DISTINCT pr_id, n FROM placed), (VALUES
  (0, 'initializing', 'Starting PR analysis...'), (10, 'fetching_pr_data', 'Fetching PR data from GitHub...'),
  (30, 'analyzing_files', 'Analyzing # files...'), (85, 'generating_summary', 'Generating analysis summary...'),
  (95, 'saving_results', 'Saving analysis results...'), (100, 'completed', 'Analysis completed successfully!')) v(p, s, m)""",
    "r05_attempts": """
SELECT task_id, seq, n + 1 AS attempt, CASE WHEN state = 'retry' THEN n <= 3 END AS retry_allowed,
       CASE WHEN state = 'retry' THEN epoch_us(ts) + 60000000 END AS retry_at
FROM (SELECT *, (sum(coalesce(state = 'retry', false)::INTEGER) OVER (PARTITION BY task_id ORDER BY ts, seq))::BIGINT AS n FROM task_events)""",
    "r05b_deduplication_stream": "SELECT task_id, seq, state FROM task_events",
    "r05c_retries_stream": """
SELECT task_id, seq, n + 1 AS attempt, n <= 3 AS retry_allowed, epoch_us(ts) + 60000000 AS retry_at
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, seq) AS n FROM task_events WHERE state = 'retry')""",
    "r06_failure_isolation": """
SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'invalid base64' WHEN 2 THEN 'invalid text' WHEN 4 THEN 'missing content' ELSE 'analysed' END AS outcome
FROM documents""",
    "x01_block_extractor": f"""
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1)::INTEGER AS block_no, raw AS block
FROM file_lines WHERE raw <> ''""",
    "x01b_extractor_similarity": _block_pairs(PARAGRAPHS) + """
SELECT file_id, total_blocks, n AS duplicates_found, best AS max_similarity FROM block_metrics""",
    "x02_embedding_model": f"""
, {_embedding("(SELECT doc_id AS file_id, text FROM documents)", "file_id")}
SELECT file_id, bucket, round(w, 6) AS weight FROM weights""",
    "x03_reviewer": f"""
SELECT file_id, 'xss' AS type, 'high' AS severity, 'm' AS message, length({SECURITY_PROMPT})::INTEGER AS line FROM code_files""",
    "x04_custom_rules": """
SELECT file_id, line::INTEGER AS line, rule_id, severity FROM findings WHERE starts_with(rule_id, 'security.')
UNION ALL SELECT file_id, line_no::INTEGER, 'custom.1', 'high' FROM lang_lines WHERE contains(line, 'eval(')
UNION ALL SELECT file_id, line_no::INTEGER, 'custom.2', 'high' FROM lang_lines WHERE regexp_matches(line, '^def f1[0-9]')""",
    "x04b_rule_rows": """
, named AS (
  SELECT 'function' AS kind, 'low' AS severity, file_id, line_no, regexp_extract(line, '^def f([0-9]+)[(][)]', 1) AS part
  FROM lang_lines WHERE language = 'python'
  UNION SELECT 'variable', 'info', file_id, line_no, unnest(regexp_extract_all(line, 'x([0-9]+) = ', 1)) FROM lang_lines
  UNION SELECT 'start', 'medium', file_id, line_no, n::VARCHAR FROM lang_lines, (SELECT unnest([0, 1, 2]) AS n)
  WHERE regexp_matches(line, '^(def|var) ' || repeat('[a-z]', n)))
SELECT file_id, line_no::INTEGER AS line, kind || '.' || part AS rule_id, severity, 'uses ' || part AS message
FROM named JOIN part ON part = p_partkey::VARCHAR""",
}


def statements() -> dict[str, str]:
    """Complete statements: the shared views followed by each question."""
    return {name: PRELUDE + sql for name, sql in ORACLE.items()}
