"""The same results in plain SQL, for the queries of :mod:`spoorlog.plans.workload`."""

from __future__ import annotations

DAY = 86_400_000
ORACLE: dict[str, str] = {}

# Events as requests; the message is what the adapters write for them.
EV = """
ev0 AS (
  SELECT event_id + 1 AS line_num, 'host-' || (user_id % 4) AS session_id, ts, epoch_us(ts) // 1000 AS ms,
         event_type, user_id, event_id, json_extract_string(props, '$.k')::INT AS k,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip, 'u' || user_id AS user_name
  FROM events),
ev AS (
  SELECT *, CASE event_type
      WHEN 'error' THEN 'Failed password for ' || user_name || ' from ' || ip || ' port ' || k || ' ssh2'
      WHEN 'signup' THEN 'Accepted password for ' || user_name || ' from ' || ip || ' port ' || k || ' ssh2'
      WHEN 'view' THEN 'GET /view?port=' || k
      WHEN 'click' THEN 'POST /click?port=' || k
      ELSE CASE k % 4 WHEN 0 THEN 'sudo reboot' WHEN 1 THEN 'su - root' WHEN 2 THEN 'usermod -aG wheel'
           ELSE 'groupadd ops' END || ' port=' || k END AS raw,
    CASE WHEN event_type = 'click' AND k < 50 THEN 401 WHEN event_type = 'click' AND k < 80 THEN 403
         ELSE 200 END AS status
  FROM ev0)"""


def _windowed(name: str, where: str, value: str, limit: int, table: str = "ev", width: int = DAY) -> str:
    """Best anchored window per session and address, with sample lines and the first matching line."""
    return f"""
{name}_r AS (SELECT session_id, ip, ms, line_num, raw, k FROM {table} WHERE {where}),
{name}_w AS (
  SELECT *, {value} OVER (PARTITION BY session_id, ip ORDER BY ms
      RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING) AS n FROM {name}_r),
{name}_b AS (
  SELECT session_id, ip, n, ms AS anchor FROM {name}_w
  QUALIFY row_number() OVER (PARTITION BY session_id, ip ORDER BY n DESC, ms, line_num) = 1 AND n > {limit}),
{name}_i AS (
  SELECT b.session_id, b.ip, b.n, r.raw, r.line_num, r.ms, r.k,
         row_number() OVER (PARTITION BY b.session_id, b.ip ORDER BY r.ms, r.line_num) AS rn
  FROM {name}_b b JOIN {name}_r r ON b.session_id = r.session_id AND b.ip = r.ip
       AND r.ms BETWEEN b.anchor AND b.anchor + {width}),
{name}_p AS (
  SELECT session_id, ip, string_agg(k::VARCHAR, ',' ORDER BY place) AS ports FROM (
    SELECT session_id, ip, k, min(rn) AS place FROM {name}_i GROUP BY session_id, ip, k
    QUALIFY row_number() OVER (PARTITION BY session_id, ip ORDER BY min(rn)) <= 10) GROUP BY ALL),
{name}_s AS (SELECT session_id, ip, min(line_num) AS seq FROM {name}_r GROUP BY 1, 2),
{name} AS (
  SELECT session_id, ip, n, string_agg(raw, chr(10) ORDER BY rn) AS lines, any_value(seq) AS seq
  FROM {name}_i JOIN {name}_s USING (session_id, ip) WHERE rn <= 3 GROUP BY session_id, ip, n)"""


FINDINGS = f"""WITH {EV},
{_windowed('ssh', "event_type = 'error'", 'count(*)', 2)},
{_windowed('web', "status IN (401, 403)", 'count(*)', 2)},
{_windowed('scan', "TRUE", 'count(DISTINCT k)', 6)},
priv AS (
  SELECT session_id, user_name, pattern, min(line_num) AS line, arg_min(raw, line_num) AS raw FROM (
    SELECT *, CASE WHEN raw LIKE '%sudo%' THEN 'sudo' WHEN raw LIKE '%su -%' THEN 'su -'
       WHEN raw LIKE '%/etc/sudoers%' THEN '/etc/sudoers' WHEN raw LIKE '%passwd%' THEN 'passwd'
       WHEN raw LIKE '%usermod%' THEN 'usermod' WHEN raw LIKE '%groupadd%' THEN 'groupadd' END AS pattern
    FROM ev) WHERE pattern IS NOT NULL GROUP BY ALL),
off AS (SELECT * FROM ev WHERE event_type = 'signup' AND (hour(ts) >= 23 OR hour(ts) < 5)),
findings AS (
  SELECT session_id, 1 AS rule_ord, seq, 'brute_force_ssh' AS type, 'high' AS severity,
    'SSH Brute Force Attack Detected from ' || ip AS title,
    'IP ' || ip || ' performed ' || n || ' failed SSH login attempts within a 1-day sliding window.' AS description,
    ip AS who, n, '-' AS ports, lines, '1 day' AS detail FROM ssh
  UNION ALL
  SELECT session_id, 2, seq, 'brute_force_web', 'medium', 'Web Brute Force Attack Detected from ' || ip,
    'IP ' || ip || ' generated ' || n || ' unauthorized HTTP responses (401/403) within a 1-day sliding window.',
    ip, n, '-', lines, '1 day' FROM web
  UNION ALL
  SELECT session_id, 3, seq, 'port_scan', 'high', 'Port Scan Activity Detected from ' || ip,
    'IP ' || ip || ' scanned ' || n || ' distinct destination ports within a 1-day time window.',
    ip, n, ports, lines, '1 day' FROM scan JOIN scan_p USING (session_id, ip)
  UNION ALL
  SELECT session_id, 4, line, 'privilege_escalation', 'medium',
    'Potential Privilege Escalation: ' || user_name || ' executing ' || pattern,
    'User "' || user_name || '" executed a command matching privilege escalation signature: "' || pattern || '".',
    user_name, 0, '-', raw, pattern FROM priv
  UNION ALL
  SELECT session_id, 5, line_num, 'off_hours_access', 'low', 'Off-Hours User Access: ' || user_name,
    'Successful user login detected during off-hours (23:00 - 05:00 UTC) for user "' || user_name || '".',
    user_name, 0, '-', raw, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') FROM off)
"""
_ALL = "SELECT *, 'rule' AS source FROM findings"

for _key, _type in {
    "brute_force": "brute_force_ssh", "web_brute_force": "brute_force_web", "port_scan": "port_scan",
    "privilege_first_seen": "privilege_escalation", "off_hours": "off_hours_access",
}.items():
    ORACLE[_key] = f"{FINDINGS} {_ALL} WHERE type = '{_type}'"
ORACLE["run_rules_union"] = ORACLE["findings_stored"] = f"{FINDINGS} {_ALL}"

ORACLE["quota_audit"] = f"""
WITH r AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, CASE event_type WHEN 'view' THEN 'analyze'
    WHEN 'click' THEN 'upload' ELSE 'report' END AS kind FROM events),
w AS (
  SELECT *, CASE kind WHEN 'analyze' THEN 2 WHEN 'upload' THEN 1 ELSE 3 END AS lim,
    CASE kind WHEN 'upload' THEN {DAY // 2} ELSE {DAY} END AS width,
    CASE kind WHEN 'upload' THEN count(*) OVER half ELSE count(*) OVER whole END AS in_window,
    CASE kind WHEN 'upload' THEN min(ms) OVER half ELSE min(ms) OVER whole END AS oldest
  FROM r WINDOW
    whole AS (PARTITION BY user_id, kind ORDER BY ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW),
    half AS (PARTITION BY user_id, kind ORDER BY ms RANGE BETWEEN {DAY // 2} PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, kind, ms, in_window,
  ceil((oldest + width - ms) / 1000.0)::BIGINT AS retry_after FROM w WHERE in_window > lim"""

# ---- parsers ----------------------------------------------------------------

_SYSLOG = """
  (ms // 1000) * 1000 AS ms, CASE WHEN event_type IN ('error', 'signup') THEN ip END AS ip,
  CASE WHEN event_type IN ('error', 'signup') THEN user_name END AS user_name,
  CASE event_type WHEN 'error' THEN 'sshd_failed' WHEN 'signup' THEN 'sshd_success' ELSE 'sshd' END AS action,
  CASE WHEN event_type IN ('view', 'click') THEN '/' || event_type ELSE 'sshd' END AS resource,
  NULL::BIGINT AS status_code, 'syslog' AS format, NULL::VARCHAR AS parse_error"""
_ACCESS = """
  (ms // 1000) * 1000 AS ms, ip, CASE WHEN event_type <> 'view' THEN user_name END AS user_name,
  'GET' AS action, '/' || event_type || '?k=' || k AS resource, status::BIGINT AS status_code,
  'apache' AS format, NULL::VARCHAR AS parse_error"""
_KV = """
  ms, ip, user_name, event_type AS action, '/' || event_type AS resource, status::BIGINT AS status_code,
  'generic' AS format, NULL::VARCHAR AS parse_error"""
_AUDIT = """
  ms, ip, user_name, event_type AS action, 'shop.example.com' AS resource,
  CASE event_type WHEN 'error' THEN 403 WHEN 'click' THEN 400 ELSE 200 END::BIGINT AS status_code,
  'cloudtrail' AS format, NULL::VARCHAR AS parse_error"""

for _key, _columns in {
    "parse_syslog": _SYSLOG, "parse_access": _ACCESS, "parse_kv": _KV, "parse_audit_json": _AUDIT
}.items():
    ORACLE[_key] = f"WITH {EV} SELECT session_id, line_num, {_columns} FROM ev"

_DAILY = "'day-' || strftime(ts, '%Y-%m-%d')"
ORACLE["parse_logs_mixed"] = f"WITH {EV} " + " UNION ALL ".join(
    f"SELECT {_DAILY} AS session_id, line_num, {columns} FROM ev WHERE day(ts) % 4 = {turn}"
    for turn, columns in enumerate((_SYSLOG, _ACCESS, _KV, _AUDIT))
)
ORACLE["detect_format"] = f"""
WITH {EV}, s AS (
  SELECT {_DAILY} AS session_id, day(any_value(ts)) % 4 AS turn, least(count(*), 5) AS n
  FROM ev GROUP BY 1)
SELECT session_id, CASE turn WHEN 3 THEN 5 * n ELSE 0 END::BIGINT AS cloudtrail_score,
  CASE turn WHEN 1 THEN 5 * n ELSE 0 END::BIGINT AS apache_score,
  CASE turn WHEN 0 THEN 5 * n ELSE 0 END::BIGINT AS syslog_score,
  CASE turn WHEN 2 THEN 7 * n ELSE 0 END::BIGINT AS generic_score,
  CASE turn WHEN 0 THEN 'syslog' WHEN 1 THEN 'apache' WHEN 2 THEN 'generic' ELSE 'cloudtrail' END AS format
FROM s"""
ORACLE["parse_quality"] = f"""
WITH {EV}, s AS (
  SELECT {_DAILY} AS session_id, day(ts) % 4 AS turn FROM ev),
f AS (SELECT *, CASE WHEN session_id < 'day-2024-01-16' THEN 'apache' ELSE 'syslog' END AS format FROM s),
g AS (SELECT *, (format = 'apache' AND turn = 1) OR (format = 'syslog' AND turn = 0) AS ok FROM f)
SELECT session_id, format, count(*) FILTER (WHERE ok) AS parsed, count(*) FILTER (WHERE NOT ok) AS failed
FROM g GROUP BY ALL"""

LINES = """
cut AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id::VARCHAR AS session_id, unnest(l) AS raw, generate_subscripts(l, 1) AS line_num FROM cut),
full_lines AS (SELECT * FROM lines WHERE regexp_matches(raw, '\\S'))"""
KV = r"""([a-zA-Z0-9_\-\.]+)\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s]+))"""
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"

ORACLE["detect_format_documents"] = f"""
WITH {LINES}, h AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_num) AS rn,
    len(regexp_extract_all(trim(raw), '{KV}')) AS pairs FROM full_lines),
s AS (SELECT session_id, sum(CASE WHEN rn <= 5 AND pairs >= 2 THEN pairs ELSE 0 END)::BIGINT AS generic_score
  FROM h GROUP BY 1)
SELECT session_id, generic_score, 'generic' AS format FROM s"""
ORACLE["sniff_by_name"] = f"""
WITH {EV} SELECT event_id, CASE WHEN line_num % 7 = 0 OR line_num % 5 = 2 THEN 'cloudtrail'
  WHEN line_num % 5 IN (0, 3) THEN 'syslog' WHEN line_num % 5 = 1 THEN 'apache' ELSE 'generic' END AS log_source FROM ev"""


def _alias(names: list[str]) -> str:
    """Value of the first alias present, its last occurrence."""
    at = "coalesce(" + ", ".join(f"nullif(list_position(ks, '{n}'), 0)" for n in names) + ")"
    return f"vs[{at}]"


ORACLE["plain_text"] = f"""
WITH {LINES}, kv AS (
  SELECT *, list_reverse(list_transform(regexp_extract_all(raw, '{KV}', 1), lambda x: lower(x))) AS ks,
    list_reverse(list_transform(regexp_extract_all(raw, '{KV}', 0), lambda x:
      regexp_extract(x, '{KV}', 2) || regexp_extract(x, '{KV}', 3) || regexp_extract(x, '{KV}', 4))) AS vs,
    lower(raw) AS low FROM full_lines)
SELECT session_id, line_num,
  CASE WHEN len(ks) = 0 THEN nullif(regexp_extract(raw, '{IPV4}'), '')
    ELSE {_alias(["ip", "ip_address", "client_ip", "sourceipaddress", "src", "src_ip", "client"])} END AS ip,
  CASE WHEN len(ks) > 0 THEN {_alias(["username", "user", "user_name", "email", "usr"])} END AS user_name,
  CASE WHEN len(ks) > 0 THEN {_alias(["action", "event", "method", "event_name", "eventname", "msg", "message", "info"])}
    WHEN contains(low, 'fail') OR contains(low, 'error') THEN 'error'
    WHEN contains(low, 'success') OR contains(low, 'login') OR contains(low, 'connect') THEN 'info'
    ELSE 'log' END AS action,
  CASE WHEN len(ks) > 0 THEN {_alias(["resource", "path", "url", "uri", "file", "target", "eventsource"])} END AS resource,
  CASE WHEN len(ks) > 0 THEN try_cast(regexp_extract(
    {_alias(["status", "statuscode", "status_code", "code"])}, '^\\s*([+-]?\\d+)', 1) AS BIGINT) END AS status_code,
  md5(raw) AS raw_md5 FROM kv"""
ORACLE["syslog_errors"] = f"""
WITH {LINES}, t AS (
  SELECT session_id, regexp_matches(trim(raw),
      '^<(\\d+)>(\\d+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\[.+?\\]|-)(?:\\s+(.*))?$')
    OR regexp_matches(trim(raw),
      '^(?:<(\\d+)>)?([A-Za-z]{{3}}\\s+\\d+\\s+\\d{{2}}:\\d{{2}}:\\d{{2}})\\s+(\\S+)\\s+([^\\[:]+)(?:\\[(\\d+)\\])?:\\s*(.*)$')
    AS ok FROM full_lines)
SELECT session_id, 'syslog' AS format, count(*) FILTER (WHERE ok) AS parsed,
  count(*) FILTER (WHERE NOT ok) AS failed FROM t GROUP BY 1"""
ORACLE["extract_ipv4"] = f"""
WITH {LINES} SELECT session_id, line_num, regexp_extract(raw, '{IPV4}') AS ip
FROM lines WHERE regexp_matches(raw, '{IPV4}')"""
ORACLE["dest_port"] = f"""
WITH {EV}, p AS (SELECT {_DAILY} AS session_id, line_num, CASE day(ts) % 4 WHEN 0 THEN k WHEN 1 THEN hour(ts)
  WHEN 3 THEN minute(ts) END::BIGINT AS port FROM ev)
SELECT session_id, line_num, port FROM p WHERE port IS NOT NULL"""

ORACLE["parse_dates"] = """
SELECT event_id, CASE WHEN event_id % 12 IN (1, 2) THEN ms ELSE ms // 1000 * 1000 END AS ms
FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)"""

# ---- files and tables -------------------------------------------------------

ORACLE["session_from_path"] = """
SELECT event_id, CASE event_type WHEN 'purchase' THEN '/in/cart-' || user_id ELSE 'u' || user_id END AS session_id,
  CASE WHEN event_type <> 'purchase' THEN epoch_us(ts) // 1000 END AS ms,
  CASE event_type WHEN 'purchase' THEN 'cart-' || user_id ELSE event_type || '_1.log' END AS upload_name
FROM events"""
ORACLE["attach_embeddings"] = """
SELECT 'label-' || label AS session_id, vec_id AS chunk_index, 'chunk ' || vec_id AS chunk_text,
  len(embedding)::BIGINT AS width, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings"""
ORACLE["line_numbers"] = """
WITH f AS (
  SELECT doc_id // 50 AS file, string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10)) AS l
  FROM documents GROUP BY 1),
n AS (SELECT file, unnest(l) AS raw, generate_subscripts(l, 1) AS line_num FROM f)
SELECT file, line_num, md5(raw) AS raw_md5 FROM n WHERE regexp_matches(raw, '\\S')"""
ORACLE["entries_table"] = f"""
WITH {EV} SELECT session_id, line_num, ms, ip, user_name,
  CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'login' WHEN 'view' THEN 'GET'
    WHEN 'click' THEN 'POST' ELSE 'exec' END AS action,
  '/' || event_type AS resource, status::BIGINT AS status_code, 'syslog' AS format,
  NULL::VARCHAR AS parse_error, md5(raw) AS raw_md5 FROM ev"""
ORACLE["vector_text"] = """
SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings"""
ORACLE["incident_reports"] = f"""
{FINDINGS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rule_ord, seq) - 1 AS pos FROM findings),
numbered AS (SELECT *, pos // 200 AS part, pos % 200 AS place FROM placed)
SELECT session_id, part, count(*) AS n, session_id AS incident,
  max(title) FILTER (WHERE place = 0) AS first_title,
  max(CASE WHEN rule_ord <= 3 THEN who ELSE 'Unknown' END) FILTER (WHERE place = 0) AS first_ip,
  max(description) FILTER (WHERE place = 1) AS second_description
FROM numbered GROUP BY session_id, part"""

ORACLE["parse_rfc5424"] = f"""
WITH {EV} SELECT session_id, line_num, ms, CASE WHEN event_type IN ('error', 'signup') THEN ip END AS ip,
  CASE WHEN event_type IN ('error', 'signup') THEN user_name END AS user_name,
  CASE event_type WHEN 'error' THEN 'sshd_failed' WHEN 'signup' THEN 'sshd_success' WHEN 'view' THEN 'event' ELSE 'sshd' END AS action,
  CASE WHEN event_type IN ('view', 'click') THEN '/' || event_type ELSE 'sshd' END AS resource,
  k::BIGINT AS status_code, 'syslog' AS format, NULL::VARCHAR AS parse_error FROM ev"""
ORACLE["valid_entries"] = f"""
WITH {EV} SELECT session_id, count(*) FILTER (WHERE line_num % 3 < 2) AS valid,
  (sum(line_num) FILTER (WHERE line_num % 3 < 2))::BIGINT AS valid_lines, count(*) FILTER (WHERE line_num % 3 = 2) AS invalid,
  (sum(line_num) FILTER (WHERE line_num % 3 = 2))::BIGINT AS invalid_lines FROM ev GROUP BY 1"""
ORACLE["own_rule"] = f"""
WITH {EV} SELECT session_id, min(line_num) AS seq, 'Potential Privilege Escalation: ' || user_name || ' executing reboot' AS title
FROM ev WHERE raw LIKE '%reboot%' GROUP BY session_id, user_name"""
ORACLE["entries_of_session"] = f"""
WITH {EV}, left_over AS (
  SELECT * FROM ev WHERE session_id IN ('host-0', 'host-3') OR session_id = 'host-1' AND event_type = 'view')
SELECT session_id, line_num, 0::BIGINT AS n FROM left_over WHERE session_id = 'host-1'
UNION ALL SELECT session_id, 0, count(*) FROM left_over GROUP BY 1"""
ORACLE["lookups"] = f"""
WITH {EV} SELECT 'id' AS kind, 'host-2' AS value UNION ALL SELECT DISTINCT 'user', session_id FROM ev
UNION ALL SELECT 'email', c_custkey::VARCHAR FROM customer WHERE c_name = 'Customer#000000007'"""
ORACLE["ingest_tables"] = f"""
WITH {EV}, s AS (SELECT {_DAILY} AS day, day(any_value(ts)) % 4 AS turn, count(*) AS n FROM ev GROUP BY 1)
SELECT day, CASE turn WHEN 0 THEN 'syslog' WHEN 1 THEN 'apache' WHEN 2 THEN 'generic' ELSE 'cloudtrail' END AS log_source,
  n AS log_count, n AS entries, 0::BIGINT AS failed, CASE WHEN n <= 75 THEN 1 ELSE ceil((n - 75) / 60.0)::BIGINT + 1 END AS chunk_count FROM s"""
ORACLE["bursts"] = f"""
WITH {EV}, wk AS (SELECT *, epoch_ms(date_trunc('week', ts)::TIMESTAMP) AS w FROM ev),
b AS (SELECT session_id, line_num, raw, k, event_type, '10.9.9.' || (line_num % 3) AS ip, w + (ms - w) // 2500 AS ms FROM wk),
{_windowed('ssh', "event_type = 'error'", 'count(*)', 10, 'b', 300_000)},
{_windowed('scan', "TRUE", 'count(DISTINCT k)', 20, 'b', 60_000)}
SELECT session_id, 'brute_force_ssh' AS type, seq, ip AS who, n,
  'IP ' || ip || ' performed ' || n || ' failed SSH login attempts within a 5-minute sliding window.' AS description,
  '5 minutes' AS detail FROM ssh
UNION ALL SELECT session_id, 'port_scan', seq, ip, n,
  'IP ' || ip || ' scanned ' || n || ' distinct destination ports within a 1-minute time window.', '1 minute' FROM scan"""

# ---- chunks and retrieval ---------------------------------------------------

# Chunks of 20 lines, a new one every 5 lines.
CHUNKS = f"""{LINES},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_num) - 1 AS pos,
    count(*) OVER (PARTITION BY session_id) AS n FROM full_lines),
counts AS (
  SELECT session_id, CASE WHEN n <= 20 THEN 1 ELSE ceil((n - 20) / 5.0)::BIGINT + 1 END AS c
  FROM placed GROUP BY session_id, n),
starts AS (SELECT session_id, unnest(range(c)) AS chunk_index FROM counts),
chunks AS (
  SELECT p.session_id, s.chunk_index, string_agg(p.raw, chr(10) ORDER BY p.pos) AS chunk_text,
    min(p.line_num) AS line_start, max(p.line_num) AS line_end
  FROM placed p JOIN starts s ON p.session_id = s.session_id
    AND p.pos >= s.chunk_index * 5 AND p.pos < s.chunk_index * 5 + 20
  GROUP BY 1, 2)"""
ORACLE["chunk_lines"] = f"""
WITH {CHUNKS} SELECT session_id, chunk_index, line_start, line_end, md5(chunk_text) AS text_md5 FROM chunks"""
ORACLE["hit_lines"] = f"""
WITH {CHUNKS}, l AS (
  SELECT *, unnest(string_split(chunk_text, chr(10))) AS line,
    generate_subscripts(string_split(chunk_text, chr(10)), 1) AS place FROM chunks)
SELECT session_id, chunk_index, line_start + place - 1 AS line_num, md5(line) AS line_md5 FROM l"""
ORACLE["embed_chunks"] = f"""
WITH {CHUNKS} SELECT session_id, chunk_index, 1536::BIGINT AS width,
  CASE WHEN regexp_matches(chunk_text, '[a-zA-Z0-9_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM chunks"""
_LETTERS = ", ".join(f"length(chunk_text) - length(replace(chunk_text, '{c}', '')) AS {c}" for c in "aeio")
ORACLE["embed_chunks_own"] = f"WITH {CHUNKS} SELECT session_id, chunk_index, {_LETTERS} FROM chunks"
ORACLE["chunks_table"] = """
SELECT 'label-' || label AS session_id, vec_id AS chunk_index, len(embedding)::BIGINT AS width,
  round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings WHERE label = 3"""
ORACLE["ann_search"] = """
SELECT 'label-' || label AS session_id, count(*) * least(count(*), 10) AS wanted, count(*) * count(*) AS pairs, count(*) AS listed,
  TRUE AS enough, TRUE AS few FROM embeddings GROUP BY label"""
ORACLE["ask_documents"] = """
SELECT conv_id || '-' || turn AS query_id, 'host-' || (conv_id % 4) AS session_id, md5(text) AS question_md5
FROM conversations WHERE role = 'user'"""
_VEC = """v AS (
  SELECT vec_id, 'label-' || label AS session_id, embedding::DOUBLE[] AS e FROM embeddings)"""
_HIT = """c.session_id, c.vec_id AS chunk_index, c.vec_id * 10 + 1 AS line_start, c.vec_id * 10 + 10 AS line_end"""
ORACLE["semantic_search"] = f"""
WITH {_VEC}, q AS (SELECT e FROM v ORDER BY vec_id LIMIT 1)
SELECT {_HIT}, 'chunk ' || c.vec_id AS chunk_text, round(list_cosine_similarity(c.e, q.e), 4) AS similarity
FROM v c, q ORDER BY list_cosine_similarity(c.e, q.e) DESC, c.session_id, c.vec_id LIMIT 10"""
ORACLE["search_batch"] = ORACLE["ann_search_all_cells"] = f"""
WITH {_VEC}, s AS (
  SELECT {_HIT}, q.vec_id AS query_id, list_cosine_similarity(c.e, q.e) AS sim
  FROM v c JOIN v q ON c.session_id = q.session_id)
SELECT session_id, query_id, row_number() OVER w AS rank, chunk_index, line_start, line_end,
  round(sim, 4) AS similarity
FROM s WINDOW w AS (PARTITION BY session_id, query_id ORDER BY sim DESC, chunk_index)
QUALIFY row_number() OVER w <= 10"""


ORACLE["ann_hits"] = f"""SELECT * FROM ({ORACLE["search_batch"]}) WHERE rank = 1"""


def _context(budget: int) -> str:
    """Snippets per source while their running length fits ``budget``.

    ``strlen`` of the characters beyond the basic plane counts once more, as
    lengths are in UTF-16 units.
    """
    return f"""WITH {CHUNKS}, hits AS (
  SELECT d.source AS query_id, c.*, 1.0 / (d.doc_id + 1) AS sim,
    '[Lines ' || line_start || '-' || line_end || ']' || chr(10) || chunk_text AS snippet
  FROM chunks c JOIN documents d ON d.doc_id::VARCHAR = c.session_id),
sums AS (
  SELECT *, row_number() OVER w AS place, sum(length(snippet)
      + len(regexp_extract_all(snippet, '[\\x{{10000}}-\\x{{10ffff}}]')) + 5) OVER (
        PARTITION BY query_id ORDER BY sim DESC, line_start, chunk_index ROWS UNBOUNDED PRECEDING) AS used
  FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, line_start, chunk_index)),
joined AS (
  SELECT query_id, coalesce(string_agg(snippet, chr(10) || '---' || chr(10) ORDER BY place)
      FILTER (WHERE used <= {budget}), '') AS context FROM sums GROUP BY 1),
asked AS (
  SELECT DISTINCT source AS query_id, 'What happened in ' || source || '?' AS question FROM documents
  UNION ALL SELECT r_name, 'Anything?' FROM region),
contexts AS (
  SELECT a.query_id, a.question, coalesce(j.context, 'No relevant log entries found for this session.') AS context
  FROM asked a LEFT JOIN joined j USING (query_id))"""


ORACLE["assemble_context"] = f"""{_context(24_000)}
SELECT query_id, length(context) AS chars, md5(context) AS context_md5 FROM contexts"""
ORACLE["build_prompts"] = f"""{_context(2_000)}
SELECT query_id, md5('Log Context:' || chr(10) || context || chr(10) || chr(10) ||
  'Question / Security Inquiry:' || chr(10) || question) AS prompt_md5 FROM contexts"""

_PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply, 'host-' || (u.conv_id % 4) AS session_id
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
ORACLE["validate_answers"] = f"""
WITH {_PAIRS} SELECT conv_id, turn,
  CASE conv_id % 5 WHEN 0 THEN 'recommendations' WHEN 1 THEN 'severity' WHEN 2 THEN 'Invalid JSON'
    WHEN 3 THEN 'findings' END AS error,
  CASE WHEN conv_id % 5 = 4 THEN 'medium' END AS severity,
  CASE WHEN conv_id % 5 = 4 THEN md5(reply) END AS summary_md5 FROM pairs"""
ORACLE["qa_history"] = f"""
WITH {_PAIRS} SELECT session_id, md5(question) AS question_md5, md5(reply) AS summary_md5,
  'medium' AS severity, 0::BIGINT AS finding_pos, 'finding ' || turn AS finding
FROM pairs WHERE conv_id % 5 = 4"""

# ---- reports ----------------------------------------------------------------

_SEVERITIES = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count"
    for s in ("critical", "high", "medium", "low", "info")
)
ORACLE["severity_matrix"] = f"{FINDINGS} SELECT session_id, {_SEVERITIES} FROM findings GROUP BY 1"
ORACLE["severity_counts"] = f"{FINDINGS} SELECT session_id, severity, count(*) AS count FROM findings GROUP BY ALL"
ORACLE["hourly_histogram"] = f"""
WITH {EV} SELECT session_id, strftime(ts, '%H:00') AS hour, count(*) AS count FROM ev GROUP BY ALL"""
_RISK = """CASE WHEN rank = 1 THEN 'Primary Target' WHEN rank <= 3 THEN 'Suspicious Vector'
  ELSE 'Moderate Interaction' END AS risk"""
ORACLE["top_sources"] = f"""
{FINDINGS}, c AS (
  SELECT session_id, who AS source, count(*) AS count, min(rule_ord * 1000000000000 + seq) AS first
  FROM findings GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY count DESC, first, source) AS rank FROM c)
SELECT session_id, source, count, rank, {_RISK} FROM r WHERE rank <= 10"""
ORACLE["top_sources_entries"] = f"""
{FINDINGS}, o AS (SELECT * FROM findings WHERE rule_ord = 5 AND session_id IN ('host-0', 'host-3')),
c AS (
  SELECT session_id, who AS source, count(*) AS count, min(seq) AS first FROM o GROUP BY 1, 2
  UNION ALL SELECT session_id, ip, count(*), min(line_num) FROM ev
  WHERE session_id NOT IN (SELECT session_id FROM o) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY count DESC, first, source) AS rank FROM c)
SELECT session_id, source, count, rank, {_RISK} FROM r WHERE rank <= 10"""
ORACLE["timeline"] = f"""
WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_num) AS rank FROM ev)
SELECT session_id, rank, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ip,
  CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'login' WHEN 'view' THEN 'GET'
    WHEN 'click' THEN 'POST' ELSE 'exec' END AS action, '/' || event_type AS resource
FROM r WHERE rank <= 20"""
ORACLE["ioc_summary"] = f"""
{FINDINGS} SELECT DISTINCT session_id, 'ip' AS kind, who AS value FROM findings WHERE rule_ord <= 3
UNION ALL SELECT DISTINCT session_id, 'port', unnest(string_split(ports, ',')) FROM findings WHERE rule_ord = 3"""
ORACLE["filter_findings"] = f"""
{FINDINGS} SELECT session_id, seq, type, title FROM findings WHERE severity = 'medium'
  AND (contains(lower(title), 'sudo') OR contains(lower(type), 'sudo') OR contains(lower(description), 'sudo'))
UNION ALL SELECT session_id, seq, type, title FROM findings
  WHERE contains(title, 'from 10.0.0.1') OR contains(type, 'from 10.0.0.1') OR contains(description, 'from 10.0.0.1')"""
ORACLE["findings_table"] = f"""
{FINDINGS} SELECT session_id, rule_ord, seq, type, upper(severity) AS severity, title,
  CASE WHEN rule_ord <= 3 THEN who ELSE 'Unknown/Internal' END AS affected,
  'Review system logs configurations.' AS recommendation FROM findings"""
ORACLE["evidence_lines"] = f"""
{FINDINGS}, l AS (
  SELECT *, unnest(string_split(lines, chr(10))) AS line,
    generate_subscripts(string_split(lines, chr(10)), 1) AS line_pos FROM findings)
SELECT session_id, rule_ord, seq, title, line_pos, line FROM l"""
_SESSIONS = f"""sessions AS (
  SELECT session_id, 'logs of ' || session_id AS name, 'completed' AS status, count(*) AS log_count,
    count(*) AS entries FROM ev GROUP BY 1
  UNION ALL SELECT r_name, 'idle', 'pending', r_regionkey, 0 FROM region)"""
ORACLE["session_dashboard"] = f"""
{FINDINGS}, {_SESSIONS}, {_PAIRS},
f AS (SELECT session_id, count(*) AS findings, {_SEVERITIES} FROM findings GROUP BY 1),
q AS (SELECT session_id, count(*) AS answers FROM pairs GROUP BY 1)
SELECT s.session_id, name, status, log_count, entries, coalesce(findings, 0) AS findings,
  coalesce(answers, 0) AS answers, coalesce(critical_count, 0) AS critical_count,
  coalesce(high_count, 0) AS high_count, coalesce(medium_count, 0) AS medium_count,
  coalesce(low_count, 0) AS low_count, coalesce(info_count, 0) AS info_count,
  coalesce(nullif(entries, 0), nullif(log_count, 0), 0)::BIGINT AS total_events
FROM sessions s LEFT JOIN f USING (session_id) LEFT JOIN q USING (session_id)"""
ORACLE["total_events"] = f"""
WITH {EV}, {_SESSIONS}
SELECT session_id, coalesce(nullif(entries, 0), nullif(log_count, 0), 0)::BIGINT AS total_events FROM sessions"""

# ---- upserts and references -------------------------------------------------

ORACLE["upsert_users"] = """
WITH u AS (
  SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS email, o_orderpriority AS name,
    CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS image, o_orderkey AS version FROM orders
  UNION ALL SELECT s_name, 'supplier', NULL, s_suppkey FROM supplier),
l AS (
  SELECT email, min(version) AS first, last(name ORDER BY version) AS name, last(image ORDER BY version) AS image
  FROM u GROUP BY 1)
SELECT coalesce(c.c_name, l.email) AS email, CASE WHEN l.email IS NOT NULL THEN l.name ELSE c.c_mktsegment END AS name,
  CASE WHEN l.email IS NOT NULL THEN l.image ELSE 'base.png' END AS image,
  coalesce(c.c_custkey, l.first) AS created, c.c_name IS NOT NULL AS kept
FROM customer c FULL JOIN l ON c.c_name = l.email"""
ORACLE["latest_state"] = """
WITH u AS (
  SELECT user_id AS id, epoch_us(ts) // 1000 AS ms, ts, event_id, event_type,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending'
      ELSE 'processing' END AS status FROM events),
l AS (SELECT id, arg_max(status, ts) AS status, max(ms) AS ms,
    arg_max(event_id, ts) FILTER (WHERE event_type = 'purchase') AS log_count FROM u GROUP BY 1)
SELECT c.c_custkey AS id, coalesce(l.status, 'pending') AS status,
  coalesce(l.log_count, c.c_nationkey)::BIGINT AS log_count, coalesce(l.ms, 0) AS ms
FROM customer c LEFT JOIN l ON c.c_custkey = l.id"""
ORACLE["unknown_updates"] = """
SELECT user_id AS id, count(*) AS updates FROM events
WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1"""
ORACLE["valid_sessions"] = f"""
WITH {LINES} SELECT session_id, count(*) AS lines FROM full_lines
WHERE session_id IN (SELECT doc_id::VARCHAR FROM labels) GROUP BY 1"""
ORACLE["orphans"] = f"""
WITH {LINES} SELECT session_id, count(*) AS lines FROM full_lines
WHERE session_id NOT IN (SELECT doc_id::VARCHAR FROM labels) GROUP BY 1"""

# ---- streams: all windows, as at the end of a replay --------------------------

ORACLE["stream_parse"] = ORACLE["parse_access"]
ORACLE["stream_off_hours"] = ORACLE["off_hours"]
ORACLE["stream_first_seen"] = f"""
WITH {EV}, p AS (
  SELECT *, CASE WHEN raw LIKE '%sudo%' THEN 'sudo' WHEN raw LIKE '%su -%' THEN 'su -' WHEN raw LIKE '%usermod%' THEN 'usermod'
    WHEN raw LIKE '%groupadd%' THEN 'groupadd' END AS pattern FROM ev)
SELECT session_id, user_name AS user, pattern, ms, line_num FROM p WHERE pattern IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session_id, user_name, pattern ORDER BY ts, line_num) = 1"""
_QUARTER = DAY // 4
ORACLE["stream_rule_counts"] = f"""
WITH {EV}, hops AS (
  SELECT session_id, ip, (ms // {_QUARTER} - back) * {_QUARTER} AS start
  FROM ev, (SELECT unnest(range(4)) AS back) WHERE event_type = 'error')
SELECT session_id, ip, start, count(*) AS count FROM hops GROUP BY 1, 2, 3 HAVING count(*) > 1"""
ORACLE["stream_brute_force_exact"] = f"""
WITH {EV}, f AS (SELECT session_id, ip, ms, line_num FROM ev WHERE event_type = 'error'),
n AS (SELECT *, (ms // {DAY}) * {DAY} AS bucket, count(*) OVER (PARTITION BY session_id, ip ORDER BY ms
    RANGE BETWEEN CURRENT ROW AND {DAY} FOLLOWING) AS value FROM f)
SELECT session_id, ip, bucket, value, ms AS anchor FROM n
QUALIFY row_number() OVER (PARTITION BY session_id, ip, bucket ORDER BY value DESC, ms) = 1 AND value > 2"""
ORACLE["stream_alerts"] = f"""
WITH {EV}, f AS (SELECT session_id, ip, ms FROM ev WHERE event_type = 'error'),
n AS (SELECT *, count(*) OVER (PARTITION BY session_id, ip ORDER BY ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS value FROM f)
SELECT DISTINCT session_id, ip, ms AS anchor, value FROM n WHERE value > 2
QUALIFY row_number() OVER (PARTITION BY session_id, ip ORDER BY ms) = 1"""
ORACLE["stream_first_seen_closed"] = ORACLE["stream_first_seen"]
ORACLE["stream_entries_table"] = ORACLE["entries_table"]
ORACLE["compact_table"] = f"""
WITH {EV} SELECT session_id, count(*) AS n, sum(line_num)::BIGINT AS lines, 1::BIGINT AS batches, 3::BIGINT AS dropped FROM ev
WHERE session_id IN ('host-0', 'host-3') OR session_id = 'host-1' AND event_type = 'view' GROUP BY 1"""
ORACLE["delete_sessions"] = f"""
{FINDINGS} SELECT session_id, count(*) AS n, 'findings' AS held FROM findings WHERE session_id NOT IN ('host-1', 'host-2') GROUP BY 1
UNION ALL SELECT session_id, count(*), 'entries' FROM ev WHERE session_id <> 'host-1' GROUP BY 1"""
ORACLE["ingest_states"] = f"""
WITH {EV}, s AS (SELECT {_DAILY} AS day, count(*) AS n FROM ev GROUP BY 1)
SELECT 'completed' AS status, count(*) AS sessions, sum(n)::BIGINT AS lines FROM s
UNION ALL SELECT 'failed', count(*), 0 FROM s UNION ALL SELECT 'observed', 0, sum(n)::BIGINT FROM s"""
