"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from ..functions import domains, network, suffixes, text
from ..functions.network import bounds
from ..operators import auth_logs, dns, iocs, processes, risk, rules

E = """e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)"""
LOGONS = f"""{E}, l AS (SELECT ts, event_id AS record_id, user_id::VARCHAR AS "user", k::VARCHAR AS source_ip, event_type = 'purchase' AS success FROM e WHERE event_type IN ('error', 'purchase'))"""
PACKETS = f"""{E}, b AS (
  SELECT event_id AS packet_num, ts, event_type = 'view' AS swap, floor(coalesce(value, 0))::BIGINT AS wire_len, 'u' || user_id AS s, (user_id % 7 + 1330)::INT AS sp, 'k' || k AS d, (k % 5 + 440)::INT AS dp FROM e
), p AS (
  SELECT packet_num, ts, wire_len, CASE WHEN swap THEN d ELSE s END AS src, CASE WHEN swap THEN dp ELSE sp END AS src_port, CASE WHEN swap THEN s ELSE d END AS dst, CASE WHEN swap THEN sp ELSE dp END AS dst_port FROM b
)"""
FLOWS = f"""{PACKETS}, f AS (
  SELECT least(src, dst) AS low, greatest(src, dst) AS high, CASE WHEN src < dst THEN src_port ELSE dst_port END AS low_port, CASE WHEN src < dst THEN dst_port ELSE src_port END AS high_port, count(*) AS packets, sum(wire_len)::BIGINT AS bytes,
    count(*) FILTER (WHERE src < dst) AS forward, count(*) FILTER (WHERE src > dst) AS reverse, arg_min(src, (ts, packet_num)) AS client, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY 1, 2, 3, 4
)"""
HOPS = """h AS (SELECT l_orderkey AS message_key, l_linenumber::INT AS hop, CASE WHEN l_linenumber % 5 <> 0 THEN min(l_shipdate)::TIMESTAMP END AS ts FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
TIMELINE = """t AS (
  SELECT o_custkey::VARCHAR AS entity, o_orderdate::TIMESTAMP AS ts, 'orders' AS source, o_orderstatus AS event, o_orderkey::VARCHAR AS ref FROM orders
  UNION ALL SELECT user_id::VARCHAR, ts, 'events', event_type, event_id::VARCHAR FROM events
)"""
HOSTS = r"""n AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '')) AS name FROM pages)"""


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TWO = words(suffixes.DEFAULT.of("plain", 2))
APEX = f"""array_to_string(list_slice(string_split({{0}}, '.'), CASE WHEN array_to_string(list_slice(string_split({{0}}, '.'), -2, -1), '.') IN ({TWO}) THEN -3 ELSE -2 END, -1), '.')"""
IP = r"""CASE WHEN list_max([x::BIGINT FOR x IN string_split(value, '.')]) <= 255 THEN list_reduce([x::BIGINT FOR x IN string_split(value, '.')], lambda a, b: a * 256 + b) END"""
IPS = rf"""ip0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')) AS value FROM documents), ips AS (SELECT doc_id, value AS ip, {IP} AS number FROM ip0 WHERE ({IP}) IS NOT NULL)"""


def ranges(number: str, cidrs: list[str]) -> str:
    return "(" + " OR ".join("{} BETWEEN {} AND {}".format(number, *bounds(c)) for c in cidrs) + ")"


def pick(values: list[str], n: str) -> str:
    return f"[{words(values)}][({n}) % {len(values)} + 1]"


def any_of(text: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {words([v])})" for v in values) + ")"


ENTROPY = """coalesce((SELECT round(-sum(p * log2(p)), 4) FROM (SELECT count(*) / length({0})::DOUBLE AS p FROM (SELECT unnest(string_split(lower({0}), '')) AS c) WHERE c <> '' GROUP BY c)), 0.0)"""

SQL: dict[str, str] = {}

BRUTE = f"""WITH {LOGONS}, g AS (
  SELECT lower("user") AS "user", count(*) FILTER (WHERE NOT success) AS failures, min(ts) FILTER (WHERE NOT success) AS first_failure, max(ts) FILTER (WHERE NOT success) AS last_failure, max(ts) FILTER (WHERE success) AS ls FROM l GROUP BY 1
), r AS (SELECT *, coalesce(ls >= first_failure, false) AS compromised FROM g WHERE failures >= 18)"""
SQL["brute_force"] = BRUTE + """ SELECT "user", failures, first_failure, last_failure, compromised, CASE WHEN compromised THEN 'CRITICAL' ELSE 'HIGH' END AS severity, failures AS evidence, CASE WHEN compromised THEN 40 ELSE 20 END AS points FROM r"""
SQL["alert_score"] = BRUTE + """ SELECT "user" AS actor, 1::BIGINT AS alerts, CASE WHEN compromised THEN 40 ELSE 20 END AS score, CASE WHEN compromised THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS verdict FROM r"""
SQL["brute_force_windowed"] = f"""WITH {LOGONS}, g AS (
  SELECT lower("user") AS "user", date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (WHERE NOT success) AS failures, min(ts) FILTER (WHERE NOT success) AS ff, max(ts) FILTER (WHERE success) AS ls FROM l GROUP BY 1, 2
) SELECT "user", day, failures, coalesce(ls >= ff, false) AS compromised, CASE WHEN coalesce(ls >= ff, false) THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM g WHERE failures >= 3"""
SQL["password_spray"] = f"""WITH {LOGONS} SELECT source_ip, count(DISTINCT "user") AS users, count(*) AS failures, min(ts) AS first_failure, max(ts) AS last_failure,
  array_to_string(list_slice(list_sort(list(DISTINCT "user")), 1, 5), ',') AS names, 'HIGH' AS severity FROM l WHERE NOT success GROUP BY 1 HAVING count(DISTINCT "user") >= 22"""
SQL["special_logons"] = f"""WITH {E}, t AS (SELECT event_id, user_id, k % 10 AS kind, event_type = 'purchase' AS ok, user_id % 2 = 0 AS ntlm FROM e WHERE event_type IN ('purchase', 'signup')),
  r AS (SELECT *, CASE WHEN ok AND kind = 9 AND ntlm THEN 'PASS_THE_HASH' WHEN ok AND kind = 8 THEN 'CLEARTEXT_LOGON' END AS alert_type FROM t)
  SELECT event_id, user_id, alert_type, CASE kind {" ".join(f"WHEN {k} THEN '{v}'" for k, v in auth_logs.LOGON_TYPES.items())} END AS logon_type FROM r WHERE alert_type IS NOT NULL"""
_SERVICES = ["C:\\Windows\\System32\\svchost.exe", "powershell -enc AAAA", "C:\\Users\\Public\\run.bat", "C:\\ProgramData\\x.exe", "mshta C:\\Temp\\a.hta"]
SQL["suspicious_services"] = f"""WITH {E}, c AS (SELECT event_id, {pick(_SERVICES, 'k')} AS command FROM e WHERE event_type = 'signup'),
  r AS (SELECT event_id, command, list_filter([CASE WHEN {any_of('lower(command)', auth_logs.EXEC_WORDS)} THEN 'exec keyword' END, CASE WHEN {any_of('lower(command)', auth_logs.WRITABLE_PATHS)} THEN 'writable path' END,
    CASE WHEN {" OR ".join(f"ends_with(lower(command), '{x}')" for x in auth_logs.SCRIPT_ENDINGS)} THEN 'script file' END], lambda x: x IS NOT NULL) AS reasons FROM c)
  SELECT event_id, command, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) >= 2 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM r WHERE len(reasons) > 0"""
SQL["priv_after_create"] = f"""WITH {E}, m AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'signup' AND value < 30)
  SELECT event_id, e.user_id::VARCHAR AS "user", m.user_id IS NOT NULL AS created_in_log, CASE WHEN m.user_id IS NOT NULL THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM e LEFT JOIN m USING (user_id) WHERE event_type = 'purchase' AND value > 80"""
SQL["events_by_type"] = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"
SQL["family_totals"] = "SELECT count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS succeeded, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS browsing, count(*) AS total FROM events"
SQL["span_by_user"] = "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds FROM events GROUP BY 1"
SQL["distinct_sets"] = f"WITH {E} SELECT event_type, array_to_string(list_sort(list(DISTINCT k)), ',') AS keys, count(DISTINCT user_id) AS users FROM e GROUP BY 1"
SQL["nx_rate"] = "WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1) SELECT user_id, total, failed, round(failed / total, 4) AS rate FROM g WHERE failed >= 10 AND failed / total >= 0.25"
SQL["impossible_travel"] = f"""WITH {E}, t AS (SELECT user_id AS "user", ts, k % 7 AS country, event_id AS record_id FROM e WHERE event_type = 'signup'),
  w AS (SELECT *, lead(ts) OVER o AS next_ts, lead(country) OVER o AS next_country, lead(record_id) OVER o AS next_record_id FROM t WINDOW o AS (PARTITION BY "user" ORDER BY ts, record_id)),
  d AS (SELECT *, (epoch_us(next_ts) - epoch_us(ts)) / 1000000 AS seconds FROM w)
  SELECT "user", ts, next_ts, country, next_country, seconds, record_id, next_record_id FROM d WHERE country <> next_country AND seconds BETWEEN 0 AND 3600"""
SQL["beaconing"] = """WITH g AS (SELECT user_id AS apex, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS gap FROM events),
  a AS (SELECT apex, count(*) AS gaps, avg(gap) AS m, median(gap) AS d, stddev_pop(gap) AS s FROM g WHERE gap > 0.05 GROUP BY 1), r AS (SELECT *, greatest(0.0, least(1.0, 1 - s / m)) AS r FROM a), b AS (SELECT *, r >= 0.70 AND m >= 1.0 AND gaps >= 4 AS is_beacon FROM r)
  SELECT apex, gaps, round(m, 2) AS mean_gap, round(d, 2) AS median_gap, round(s, 2) AS deviation, round(r, 3) AS regularity, is_beacon, CASE WHEN NOT is_beacon THEN 'LOW' WHEN r >= 0.88 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM b WHERE is_beacon OR gaps >= 8"""
DELAY = f"""{HOPS}, d AS (SELECT *, (epoch_us(ts) - epoch_us(last_value(ts IGNORE NULLS) OVER (PARTITION BY message_key ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1000000 AS delay FROM h)"""
SQL["hop_delays"] = f"WITH {DELAY} SELECT message_key, hop, delay, coalesce(delay < 0, false) AS skewed, coalesce(delay > 86400, false) AS late FROM d"
SQL["time_travel"] = f"WITH {HOPS}, w AS (SELECT *, max(hop) OVER (PARTITION BY message_key ORDER BY ts, hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM h WHERE ts IS NOT NULL) SELECT message_key, hop, passed FROM w WHERE hop < passed"
SQL["route_origins"] = f"""WITH {DELAY} SELECT message_key, CASE WHEN max(hop % 2 = 0) THEN '8.8.8.' || min(hop) FILTER (WHERE hop % 2 = 0) ELSE '203.0.113.' || min(hop) END AS origin, count(*) AS hops, sum(greatest(0.0, coalesce(delay, 0.0))) AS transit FROM d GROUP BY 1"""
SQL["timeline_union"] = f"WITH {TIMELINE} SELECT * FROM t"
SQL["timeline_delta"] = f"""WITH {TIMELINE}, d AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts, source, ref)) / 1000000, 0.0) AS delta FROM t), s AS (SELECT *, floor(delta)::BIGINT AS s FROM d)
  SELECT entity, ts, source, ref, delta, '+' || CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS delta_text, delta > 3600 AS excessive FROM s"""
SQL["alert_band_tag"] = "SELECT a.event_id AS alert_id, a.user_id, b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) < 600 * 1000000"
ASOF = "(SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts)"
SQL["asof_parent"] = f"SELECT event_id, user_id, {ASOF} AS parent FROM events p WHERE event_type = 'purchase'"
SQL["event_attach_fallback"] = f"SELECT event_id, user_id, coalesce({ASOF}, (SELECT arg_min(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id)) AS process FROM events p WHERE event_type = 'view'"
SQL["event_attach_guid"] = f"""WITH p AS (SELECT * FROM events WHERE event_type = 'signup' AND event_id % 5 < 3), g AS (SELECT 'g' || (event_id % 211) AS guid, arg_max(event_id, (ts, event_id)) AS named FROM p GROUP BY 1)
  SELECT v.event_id, v.user_id, coalesce(g.named, {ASOF.replace("FROM events s WHERE s.event_type = 'signup' AND", "FROM p s WHERE").replace("p.user_id", "v.user_id").replace("p.ts", "v.ts")}, (SELECT arg_min(s.event_id, (s.ts, s.event_id)) FROM p s WHERE s.user_id = v.user_id)) AS process FROM events v LEFT JOIN g ON event_id % 3 > 0 AND guid = 'g' || (v.event_id % 211) WHERE event_type = 'view'"""
SQL["process_depth"] = "SELECT event_id AS node, floor(log2(event_id) + 1e-9)::INT AS depth FROM events WHERE event_id > 0"
_NAME = "lower(regexp_extract({0}, '([^\\\\/]*)$', 1))"
_IMG = ["C:\\Windows\\cmd.exe", "C:\\Windows\\System32\\certutil.exe", "powershell.exe", "C:\\Tools\\notepad.exe", "rundll32.exe", "vssadmin.exe", "mshta.exe", "regsvr32.exe", "bitsadmin.exe", "wmic.exe", "wbadmin.exe", "bcdedit.exe", "procdump64.exe", "whoami.exe", "bash.exe"]
_PAR = ["C:\\Office\\WINWORD.EXE", "w3wp.exe", "explorer.exe", "services.exe", "spoolsv.exe", "java.exe", "EXCEL.EXE"]
_CMD = ["run /c dir", "-urlcache http://x", "-enc AAAA", "delete shadows /all", "comsvcs.dll minidump lsass", "javascript:alert(1)", "/s /u /i:http://x scrobj.dll", "/transfer job http://x y", "shadowcopy delete", "delete catalog -quiet", "/set {default} recoveryenabled no", "-ep bypass iex(1)", "url.dll,openurl"]
_RULES = [
    ("OFFICE_MACRO_SPAWN", "CRITICAL", "T1204.002", f"p IN ({words(processes.OFFICE_PARENTS)}) AND (n IN ({words(processes.SHELLS)}) OR {any_of('n', ['cmd', 'powershell', 'wscript', 'cscript', 'mshta', 'certutil'])})"),
    ("WEB_SHELL_SPAWN", "CRITICAL", "T1505.003", f"p IN ({words(processes.WEB_PARENTS)}) AND (n IN ({words(processes.SHELLS)}) OR {any_of('n', ['cmd', 'powershell', 'whoami', 'net', 'bash', 'sh'])})"),
    ("SUSPICIOUS_SERVICE_SPAWN", "CRITICAL", "T1059", f"p IN ({words(processes.SERVICE_PARENTS)}) AND n IN ('cmd.exe', 'powershell.exe', 'pwsh.exe')"),
    *((f"LOLBAS_{t.upper()}", s, m, f"contains(n, '{t}') AND {any_of('c', w)}") for t, s, m, w in processes.TOOL_RULES),
    ("SHADOW_COPY_DELETION", "CRITICAL", "T1490", "(contains(n, 'vssadmin') AND contains(c, 'delete') AND contains(c, 'shadows')) OR (contains(n, 'wmic') AND contains(c, 'shadowcopy') AND contains(c, 'delete')) OR (contains(n, 'wbadmin') AND contains(c, 'delete')) OR (contains(n, 'bcdedit') AND contains(c, 'recoveryenabled') AND contains(c, 'no'))"),
    ("ENCODED_COMMAND", "HIGH", "T1059.001", f"{any_of('n', ['powershell', 'pwsh'])} AND {any_of('c', processes.ENCODED_FLAGS)}"),
    ("CREDENTIAL_DUMPING", "CRITICAL", "T1003", f"{any_of('c', processes.DUMP_WORDS)} AND {any_of('n', processes.DUMP_TOOLS)}"),
]
SQL["process_rules"] = f"WITH {E}, q AS (SELECT event_id, {_NAME.format(pick(_IMG, 'k'))} AS n, {_NAME.format(pick(_PAR, 'user_id'))} AS p, lower({pick(_CMD, 'event_id')}) AS c FROM e) " + " UNION ALL ".join(f"SELECT event_id, '{r}' AS rule, '{s}' AS severity, '{m}' AS mitre FROM q WHERE {w}" for r, s, m, w in _RULES)
SQL["audit_rules"] = f"""WITH {E}, q AS (SELECT event_id, k, user_id, {pick(["New-InboxRule", "Add-MailboxPermission", "Consent to application.", "assign_role", "UserLoggedIn"], 'event_id')} AS op FROM e)
  SELECT event_id, 'EXTERNAL_FORWARDING' AS rule, 'CRITICAL' AS severity, 'T1114.003' AS mitre FROM q WHERE op = 'New-InboxRule' AND k % 3 = 0
  UNION ALL SELECT event_id, 'EMAIL_HIDING_RULE', 'HIGH', 'T1564.008' FROM q WHERE op = 'New-InboxRule' AND (k % 2 = 0 OR k % 3 = 0)
  UNION ALL SELECT event_id, 'UNAUTHORIZED_MAILBOX_DELEGATION', 'HIGH', 'T1098.002' FROM q WHERE op = 'Add-MailboxPermission' AND (k % 2 = 0 OR user_id % 2 = 0)
  UNION ALL SELECT event_id, 'HIGH_RISK_OAUTH_CONSENT', 'HIGH', 'T1528' FROM q WHERE op LIKE 'Consent%' AND k % 2 = 0
  UNION ALL SELECT event_id, 'SUSPICIOUS_ADMIN_ACTIVITY', 'HIGH', 'T1098' FROM q WHERE op = 'assign_role'"""
SQL["flow_table"] = f"WITH {FLOWS} SELECT * FROM f"
SQL["flow_enriched"] = f"""WITH {FLOWS} SELECT low, high, low_port, high_port, packets, 'c' || (substr(low, 2)::INT % 4) AS low_country, CASE WHEN substr(low, 2)::INT % 3 = 0 THEN 'CLOUD' END AS low_tag, 'c' || (substr(high, 2)::INT % 4) AS high_country, substr(high, 2)::INT % 11 = 0 AS high_is_anonymous FROM f"""
SQL["top_talkers"] = f"WITH {PACKETS}, a AS (SELECT src AS host, wire_len FROM p UNION ALL SELECT dst, wire_len FROM p) SELECT host, sum(wire_len)::BIGINT AS bytes, count(*) AS packets FROM a GROUP BY 1 ORDER BY bytes DESC, host LIMIT 10"
SQL["top_ports"] = f"WITH {PACKETS}, a AS (SELECT packet_num, src_port AS port FROM p UNION SELECT packet_num, dst_port FROM p) SELECT port, count(*) AS packets FROM a GROUP BY 1 ORDER BY packets DESC, port LIMIT 10"
SQL["capture_risk"] = f"""WITH {PACKETS}, s AS (SELECT ts::DATE::VARCHAR AS day, src AS host, CASE WHEN src_port = 1336 THEN 1337 ELSE src_port END AS port FROM p UNION SELECT ts::DATE::VARCHAR, dst, dst_port FROM p),
  g AS (SELECT day, bool_or(host IN ('k7', 'u3')) AS anonymous, bool_or(port IN (1337, 4444, 6667)) AS suspicious_port FROM s GROUP BY 1), x AS (SELECT *, CASE WHEN anonymous THEN 35 ELSE 0 END + CASE WHEN suspicious_port THEN 25 ELSE 0 END AS score FROM g)
  SELECT *, CASE WHEN score >= 60 THEN 'MALICIOUS' WHEN score >= 25 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict FROM x"""
SQL["cidr_enrich"] = f"WITH {IPS} SELECT doc_id, ip, CASE WHEN ip LIKE '97.51.%' THEN 'narrow' ELSE 'net' || (number >> 28) END AS net FROM ips"
SQL["tor_flag"] = f"WITH {IPS} SELECT doc_id, ip, {ranges('number', network.TOR_RANGES)} AS is_tor, {ranges('number', network.SPECIAL_RANGES)} AS is_private, number // 256 AS subnet FROM ips"
_PROVIDER = "CASE WHEN asn = 16509 THEN 'AWS' WHEN org IS NOT NULL THEN 'Hetzner' END"
SQL["ip_risk"] = f"""WITH {IPS}, x AS (SELECT *, CASE number % 3 WHEN 0 THEN 16509 WHEN 1 THEN 9009 END AS asn, CASE WHEN number % 5 = 0 THEN 'Hetzner Online' END AS org FROM ips)
  SELECT doc_id, ip, CASE WHEN {ranges('number', network.SPECIAL_RANGES)} THEN 10 WHEN {ranges('number', network.TOR_RANGES)} THEN 85 WHEN asn = 9009 THEN 65 WHEN {_PROVIDER} IS NOT NULL THEN 45 ELSE 35 END AS risk, {_PROVIDER} AS provider FROM x"""
_TARGETS = ["ththre", "thther", "erenan", "within", "theand", "nicht"]
_LOOK = "replace(translate(lower(name), '" + "".join(text.LOOKALIKES) + "', '" + "".join(text.LOOKALIKES.values()) + "'), 'vv', 'w')"
SQL["lookalike_domains"] = f"""WITH {HOSTS}, d AS (SELECT DISTINCT lower(string_split(name, '.')[1]) AS name FROM n), t AS (SELECT unnest([{words(_TARGETS)}]) AS target), c AS (SELECT d.name, t.target FROM d, t WHERE d.name NOT IN (SELECT target FROM t)),
  k AS (SELECT *, CASE WHEN {_LOOK} = target THEN 'HOMOGLYPH' WHEN length(target) >= 4 AND levenshtein(name, target) BETWEEN 1 AND 2 THEN 'TYPOSQUAT' WHEN length(target) >= 4 AND contains(name, target) THEN 'COMBOSQUAT' END AS kind, round(1 - levenshtein(name, target) / greatest(length(name), length(target)), 4) AS similarity FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'HOMOGLYPH' THEN 0 WHEN 'TYPOSQUAT' THEN 1 ELSE 2 END, similarity DESC, target) AS i FROM k WHERE kind IS NOT NULL) SELECT name, target, kind, similarity FROM r WHERE i = 1"""
A = APEX.format("name")
SUB = f"CASE WHEN length(name) > length({A}) THEN substr(name, 1, length(name) - length({A}) - 1) ELSE '' END"
KEYS = r"[lower(x) FOR x IN regexp_extract_all('&' || regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&([^=&]+)', 1)]"
SQL["url_features"] = f"""WITH {HOSTS} SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, name AS host, {A} AS apex, {SUB} AS sub, string_split(name, '.')[-1] AS tld, len({KEYS})::INT AS parameters, false AS is_ip FROM n"""
PORT = r"TRY_CAST(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)', 1) AS INT)"
POINTS = f"""(CASE WHEN contains(name, 'xn--') THEN 45 ELSE 0 END + CASE WHEN {A} IN ({words(domains.SHORTENERS)}) THEN 20 ELSE 0 END + CASE WHEN string_split(name, '.')[-1] IN ({words(domains.RISKY_TLDS)}) THEN 15 ELSE 0 END + CASE WHEN coalesce({PORT} NOT IN (80, 443, 8080, 8443), false) THEN 20 ELSE 0 END
  + CASE WHEN list_has_any({KEYS}, [{words(domains.IDENTITY_PARAMETERS)}]) THEN 25 ELSE 0 END + CASE WHEN list_has_any({KEYS}, [{words(domains.REDIRECT_PARAMETERS)}]) THEN 15 ELSE 0 END)"""
SQL["url_score"] = f"WITH {HOSTS} SELECT page_id, least(100, {POINTS}) AS score FROM n"
_DEFANG = r"""replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1), 'http', 'hxxp') || replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '.', '[.]') || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1)"""
SQL["defang_roundtrip"] = f"SELECT page_id, {_DEFANG} AS defanged, url AS refanged FROM pages"
SQL["anchor_links"] = r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']+["''][^>]*>.*?</a>')) AS p FROM pages), b AS (SELECT page_id, regexp_extract(p, '(?is)\bhref\s*=\s*["'']([^"'']+)', 1) AS url, trim(regexp_replace(p, '(?s)<[^>]*>', '', 'g')) AS anchor FROM a)
  SELECT DISTINCT page_id, url, anchor FROM b WHERE NOT regexp_matches(url, '(?i)^(mailto|tel|javascript|data|cid|#|about):?')"""
SQL["link_reports"] = f"""WITH {HOSTS}, f AS (SELECT *, least(100, {POINTS}) AS points, list_filter([CASE WHEN coalesce({PORT} NOT IN (80, 443, 8080, 8443), false) THEN 'SUSPICIOUS_PORT' END, CASE WHEN string_split(name, '.')[-1] IN ({words(domains.RISKY_TLDS)}) THEN 'SUSPICIOUS_TLD' END,
  CASE WHEN list_has_any({KEYS}, [{words(domains.IDENTITY_PARAMETERS)}]) THEN 'CREDENTIAL_PHISH_PARAM' END, CASE WHEN list_has_any({KEYS}, [{words(domains.REDIRECT_PARAMETERS)}]) THEN 'OPEN_REDIRECT_PARAM' END], lambda x: x IS NOT NULL) AS flags FROM n),
  g AS (SELECT array_to_string(list_slice(string_split(name, '.'), -2, -1), '.') AS site, count(*) AS links, count(DISTINCT {A}) AS domains, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS flags, max(points) AS score FROM f GROUP BY 1)
  SELECT *, CASE WHEN score >= 60 THEN 'MALICIOUS' WHEN score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM g"""
SQL["html_comments"] = "WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS c FROM pages) SELECT page_id, count(*) AS comments, max(length(trim(c, ' ')))::INT AS longest FROM c WHERE length(trim(c, ' ')) >= 3 GROUP BY 1"
SQL["text_entropy"] = f"WITH {HOSTS} SELECT page_id, {ENTROPY.format('name')} AS entropy FROM n"
_LETTERS = "len(regexp_extract_all(l, '[a-zA-Z]'))"
_VOWELS = f"CASE WHEN {_LETTERS} > 0 THEN len(regexp_extract_all(lower(l), '[aeiou]')) / {_LETTERS} ELSE 0 END"
_RUN = "coalesce(list_max([length(x) FOR x IN regexp_extract_all(lower(l), '[b-df-hj-np-tv-z]+')]), 0)"
_DIGITS = "len(regexp_extract_all(l, '[0-9]'))"
SQL["dga_score"] = f"""WITH {HOSTS}, b AS (SELECT page_id, string_split(name, '.')[1] AS l FROM n), v AS (SELECT page_id, l, length(l) AS n, {ENTROPY.format('l')} AS e, {_VOWELS} AS v, {_RUN} AS c, {_DIGITS} AS d, {_LETTERS} AS a FROM b)
  SELECT page_id, round(v, 4) AS vowels, c::INT AS consonants, CASE WHEN n >= 7 THEN least(1.0, (CASE WHEN e >= 3.7 AND n >= 9 THEN 40 ELSE 0 END + CASE WHEN (v < 0.18 OR v > 0.65) AND a >= 8 THEN 35 ELSE 0 END + CASE WHEN c >= 5 THEN 30 ELSE 0 END + CASE WHEN d >= 4 OR d / n >= 0.35 THEN 25 ELSE 0 END + CASE WHEN regexp_matches(lower(l), '^[0-9a-f]{{10,}}$') THEN 30 ELSE 0 END) / 100) ELSE 0.0 END AS score FROM v"""
KIND = """CASE WHEN regexp_matches(q, '^[0-9a-fA-F]{{8,}}$') THEN 'HEX' WHEN regexp_matches(lower(q), '^[a-z2-7=]+$') AND length(q) >= 8 AND (regexp_matches(q, '[2-7]') OR length(q) >= 16) THEN 'BASE32'
  WHEN length(q) >= 12 AND regexp_matches({0}, '^[a-zA-Z0-9_-]+$') AND regexp_matches({0}, '[-_]') THEN 'BASE64URL' WHEN length(q) >= 16 AND regexp_matches({0}, '[A-Z]') AND regexp_matches({0}, '[a-z]') AND regexp_matches({0}, '[0-9=]') THEN 'BASE64'
  WHEN length(q) >= 16 AND {1} >= 4.4 THEN 'BINARY_RAW' ELSE 'UNKNOWN' END"""
SQL["encoding_class"] = f"WITH {HOSTS}, b AS (SELECT page_id, string_split(name, '.')[1] AS l, regexp_replace(string_split(name, '.')[1], '[.-]', '', 'g') AS q FROM n) SELECT page_id, {KIND.format('l', ENTROPY.format('q'))} AS kind FROM b"
COVERT = f"""b AS (SELECT *, {A} AS apex, {SUB} AS sub FROM n), c AS (SELECT *, regexp_replace(sub, '[.-]', '', 'g') AS q FROM b), v AS (SELECT *, length(sub) AS m, {ENTROPY.format('sub')} AS ent, {KIND.format('sub', ENTROPY.format('q'))} AS kind FROM c),
  s AS (SELECT *, m > 40 OR (ent >= 4.5 AND m >= 12) OR (ent >= 3.9 AND m >= 24) OR (kind IN ('HEX', 'BASE32', 'BASE64URL', 'BASE64') AND (m >= 16 OR ent >= 3.8)) AS suspicious FROM v)"""
SQL["subdomain_check"] = f"WITH {HOSTS}, {COVERT} SELECT page_id, sub, m::INT AS n, suspicious FROM s"
SQL["dns_tunnel_like"] = f"""WITH {HOSTS.replace('n AS', 'n0 AS', 1)}, n AS (SELECT page_id, md5(url) || '.' || name AS name FROM n0), {COVERT}, g AS (SELECT apex, count(*) AS queries, count(DISTINCT name) AS names, count(*) FILTER (WHERE ent >= 4.0 OR suspicious) AS entropic, max(m)::INT AS longest, sum(m)::BIGINT AS bytes,
    bool_or(page_id % 3 = 0) AS t, bool_or(kind <> 'UNKNOWN') AS c FROM s WHERE apex NOT IN ({words(dns.BENIGN_ROOTS)}) GROUP BY 1 HAVING count(*) >= 3),
  x AS (SELECT *, entropic >= 5 OR (queries >= 5 AND entropic / queries >= 0.5) AS busy, longest >= 50 OR bytes / queries >= 30 AS large FROM g), y AS (SELECT *, (queries >= 10 AND names / queries >= 0.75)::INT + busy::INT + large::INT + t::INT + c::INT + (bytes >= 2048)::INT AS signs FROM x)
  SELECT apex, queries, names, entropic, longest, bytes, signs, CASE WHEN bytes >= 2048 THEN 'CRITICAL' WHEN busy OR large OR c THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM y WHERE signs >= 2 OR (entropic >= 4 AND longest >= 35)"""
SQL["fast_flux_like"] = f"""WITH {IPS}, a AS (SELECT source AS domain, ip, number % 600 AS ttl, number // 256 AS net FROM ips JOIN documents USING (doc_id)), g AS (SELECT domain, count(DISTINCT ip) AS ips, min(ttl) AS min_ttl, round(avg(ttl), 2) AS avg_ttl, count(DISTINCT net) AS subnets FROM a GROUP BY 1), s AS (SELECT source AS domain, count(DISTINCT lang) AS name_servers FROM documents GROUP BY 1)
  SELECT domain, ips, min_ttl, avg_ttl, subnets, name_servers, CASE WHEN name_servers >= 3 THEN 'DOUBLE_FLUX' ELSE 'SINGLE_FLUX' END AS flux, CASE WHEN name_servers >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM g JOIN s USING (domain) WHERE ips >= 3 AND (min_ttl <= 300 OR avg_ttl <= 300) AND (ips >= 4 OR subnets >= 3)"""
SQL["hash_watchlist"] = "SELECT DISTINCT doc_id, sha256(text) AS value FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE length(text) < 100)"


def found(table: str, key: str, column: str, kinds: list[str]) -> str:
    """Rows (item key, ioc_type, value) of the indicators of a table."""
    parts = [f"SELECT {key}, '{k}' AS ioc_type, unnest(regexp_extract_all({column}, '{iocs.PATTERNS[k]}')) AS value FROM {table}" for k in kinds]
    return f"(SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE ioc_type <> 'ipv4' OR list_max([TRY_CAST(x AS BIGINT) FOR x IN string_split(value, '.')]) <= 255)"


LEVEL = "CASE WHEN ioc_type = 'eth' THEN 'HIGH' ELSE 'LOW' END"
SQL["ioc_extract"] = f"SELECT doc_id, ioc_type, value, count(*) AS n, {LEVEL} AS severity FROM {found('documents', 'doc_id', 'text', ['ipv4', 'email', 'md5', 'sha1', 'sha256', 'eth'])} GROUP BY ALL"
SQL["secret_leaks"] = """WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1)) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) <= 6 THEN repeat('*', length(s)) ELSE substr(s, 1, 2) || repeat('*', length(s) - 4) || right(s, 2) END AS masked, length(s)::INT AS n FROM s"""
SIGHTINGS = "s AS (" + " UNION ALL ".join(f"SELECT '{t}-' || {k} AS item, ioc_type, value FROM {found(t, k, c, ['ipv4', 'email', 'sha1'])}" for t, k, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"))) + ")"
SQL["shared_ioc"] = f"WITH {SIGHTINGS} SELECT ioc_type, lower(trim(value)) AS value, count(DISTINCT item) AS items, count(*)::BIGINT AS sightings, array_to_string(list_slice(list_sort(list(DISTINCT item)), 1, 20), ',') AS seen_in FROM s WHERE length(trim(value)) >= 4 GROUP BY 1, 2 HAVING count(DISTINCT item) >= 2"
SQL["shared_ioc_rows"] = f"WITH {SIGHTINGS}, v AS (SELECT ioc_type, lower(trim(value)) AS value, item, count(*) AS sightings FROM s WHERE length(trim(value)) >= 4 GROUP BY 1, 2, 3) SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY ioc_type, value) >= 2"
SQL["first_iocs"] = f"WITH {SIGHTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY ioc_type, lower(trim(value)) ORDER BY item, value) AS i FROM s) SELECT item, ioc_type, value FROM r WHERE i = 1"
_TEXT = [("licence", "LOW", 10, 1, ["(?i)all rights reserved", "(?i)general public license"]), ("credentials", "HIGH", 40, 2, ["token = ", "[0-9a-f]{40}"]), ("abuse", "MEDIUM", 20, 2, [rf"(?i)\b{w}\b" for w in ("stupid", "pathetic", "disgusting", "trash", "idiot")])]
_HITS = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, '{}' AS severity, {} AS score, ({}) AS hits, {} AS need FROM documents".format(n, s, p, " + ".join(f"regexp_matches(coalesce(text, ''), '{x}')::INT" for x in ps), need) for n, s, p, need, ps in _TEXT)
SQL["rule_scan_any_all"] = f"SELECT doc_id, rule, severity, score, hits FROM ({_HITS}) WHERE hits >= need"
SQL["rule_attribution"] = f"WITH h AS ({SQL['rule_scan_any_all']}) SELECT doc_id, count(DISTINCT rule) AS families, least(100, max(score) + least(15, 5 * (count(DISTINCT rule) - 1)))::INT AS score FROM h GROUP BY 1"
_PAGE = [(n, s, p, ps) for n, _, s, p, ps in (rules.PROMPT_INJECTION, rules.SCRIPT_PAYLOADS, *rules.FRAUD_WORDING)]
_PHITS = " UNION ALL ".join("SELECT page_id, '{}' AS rule, '{}' AS severity, {} AS score, ({}) AS hits FROM pages".format(n, s, p, " + ".join("regexp_matches(coalesce(html, ''), '{}')::INT".format(x.replace("'", "''")) for x in ps)) for n, s, p, ps in _PAGE)
SQL["prompt_injection_scan"] = f"SELECT * FROM ({_PHITS}) WHERE hits >= 1"
SQL["zero_width"] = f"SELECT doc_id, (length(text) - length(translate(text, '{text.ZERO_WIDTH}', '')))::INT AS n, length(translate(text, '{text.ZERO_WIDTH}', ''))::INT AS visible FROM documents"
_CAPS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in risk.CAPS.items())
_VEC = list(risk.CAPS)
VECTORS = f"""{E}, f AS (SELECT user_id, CASE event_type WHEN 'error' THEN '{_VEC[0]}' WHEN 'click' THEN '{_VEC[1]}' WHEN 'purchase' THEN '{_VEC[2]}' WHEN 'view' THEN '{_VEC[3]}' ELSE '{_VEC[4]}' END AS vector, k / 8 AS points, k > 80 AS c FROM e),
  v AS (SELECT user_id, vector, least(sum(points), CASE vector {_CAPS} END) AS score, count(*) AS factors, bool_or(c) AS critical FROM f GROUP BY 1, 2)"""
SQL["risk_vectors"] = f"WITH {VECTORS} SELECT * FROM v"
SQL["risk_total"] = f"""WITH {VECTORS}, t AS (SELECT user_id, round(least(100.0, sum(score)), 1) AS score, bool_or(critical) AS c FROM v GROUP BY 1)
  SELECT user_id, score, CASE WHEN score >= 90 OR (score >= 75 AND c) THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 20 THEN 'SUSPICIOUS_LOW' ELSE 'CLEAN' END AS level FROM t"""
SQL["case_risk"] = """WITH g AS (SELECT source AS case_id, max(n_chars % 101)::DOUBLE AS m, avg(n_chars % 101) AS a, count(*) AS items, count(*) FILTER (WHERE lang = 'es') AS correlations FROM documents GROUP BY 1)
  SELECT case_id, items, correlations, round(least(100.0, greatest(0.7::DOUBLE * m + 0.3::DOUBLE * a + least(10 * correlations, 30), m)), 2) AS score FROM g"""
SQL["item_scores"] = f"""WITH {E} SELECT event_id, least(100, CASE event_type WHEN 'error' THEN CASE WHEN k > 80 THEN 45 WHEN k > 50 THEN 35 WHEN k % 5 > 0 THEN 25 ELSE 0 END WHEN 'click' THEN CASE WHEN k > 80 THEN 50 WHEN k > 50 THEN 40 ELSE 0 END WHEN 'view' THEN CASE WHEN k % 5 > 0 THEN 30 + 15 * (k % 5) ELSE 0 END ELSE CASE WHEN k > 80 THEN 60 WHEN k % 5 > 0 THEN 30 ELSE 0 END END) AS score FROM e"""
SQL["tactic_matrix"] = """WITH t AS (SELECT CASE event_type WHEN 'error' THEN 'T1110.001' WHEN 'click' THEN 'T1566.002' WHEN 'purchase' THEN 'T1098' WHEN 'view' THEN 'T1059.001' ELSE 'T1999' END AS t FROM events)
  SELECT CASE t WHEN 'T1110.001' THEN 'Credential Access' WHEN 'T1566.002' THEN 'Initial Access' WHEN 'T1098' THEN 'Persistence' WHEN 'T1059.001' THEN 'Execution' ELSE 'Other' END AS tactic, t AS techniques, count(*) AS alerts FROM t GROUP BY 1, 2"""
SQL["manifest_digests"] = "SELECT sha256(doc_id::VARCHAR) AS evidence_id, doc_id, octet_length(encode(text)) AS bytes, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents"
SQL["custody_verify"] = "SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'FILE_NOT_FOUND' WHEN doc_id % 5 = 0 THEN 'TAMPER_DETECTED' ELSE 'VERIFIED' END AS status, CASE WHEN doc_id % 7 <> 3 AND doc_id % 5 = 0 THEN 'md5,sha1,sha256,sha512' ELSE '' END AS differing FROM documents"
SQL["ledger_state"] = "WITH a AS (SELECT user_id::VARCHAR AS evidence_id, CASE WHEN event_type = 'error' THEN 'TAMPER_DETECTED' ELSE upper(event_type) END AS action, ts, event_id::VARCHAR AS i FROM events) SELECT evidence_id, count(*) AS events, arg_max(action, (ts, i)) AS last_action, bool_or(action = 'TAMPER_DETECTED') AS tampered FROM a GROUP BY 1"
SQL["kill_chain"] = f"WITH {E} SELECT k AS case_id, bool_or(event_type = 'error') AND bool_or(event_type = 'purchase' AND value > 95) AS kill_chain FROM e GROUP BY 1"
SQL["stix_patterns"] = f"""WITH f AS (SELECT DISTINCT ioc_type, value FROM {found('documents', 'doc_id', 'text', ['ipv4', 'email', 'sha1'])}), h AS (SELECT *, sha256(ioc_type || '|' || value) AS h FROM f)
  SELECT 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS stix_id, ioc_type,
  '[' || CASE ioc_type WHEN 'ipv4' THEN 'ipv4-addr:value' WHEN 'email' THEN 'email-addr:value' ELSE 'file:hashes.''SHA-1''' END || ' = ''' || value || ''']' AS pattern FROM h"""
SQL["stix_bundles"] = SQL["stix_patterns"].replace("SELECT DISTINCT ioc_type, value", "SELECT DISTINCT doc_id % 3 AS case_id, ioc_type, value").replace("AS stix_id, ioc_type,", "AS stix_id, case_id,")
SQL["ioc_ledger"] = f"SELECT DISTINCT source AS case_id, doc_id::VARCHAR AS item_id, ioc_type, value, 'LOW' AS severity FROM {found('documents', 'doc_id', 'text', ['ipv4', 'email', 'sha1'])} JOIN documents USING (doc_id)"
_URGENT = " OR ".join("regexp_matches(' ' || text, '{}')".format(x.replace("'", "''")) for _, _, _, _, ps in rules.FRAUD_WORDING for x in ps)
SQL["mail_fraud"] = f"""WITH m AS (SELECT conv_id || '-' || turn AS message_key, conv_id AS n, text FROM conversations), i AS (
  SELECT message_key, 'REPLY_TO_DOMAIN_MISMATCH' AS i, 40 AS p FROM m WHERE n % 5 = 0
  UNION ALL SELECT message_key, 'RETURN_PATH_MISMATCH', 10 FROM m WHERE n % 2 = 0 AND n % 3 <> 2
  UNION ALL SELECT message_key, 'DISPOSABLE_EMAIL_DOMAIN', 25 FROM m WHERE n % 3 = 1
  UNION ALL SELECT message_key, 'DISPLAY_NAME_EMBEDDED_EMAIL_SPOOF', 50 FROM m WHERE n % 4 = 1
  UNION ALL SELECT message_key, 'EXECUTIVE_TITLE_FREEMAIL_SPOOF', 25 FROM m WHERE n % 4 = 0 AND n % 3 = 0
  UNION ALL SELECT message_key, 'BEC_URGENCY_KEYWORDS', 20 FROM m WHERE {_URGENT}
), g AS (SELECT message_key, least(100, sum(p))::INT AS score, array_to_string(list_sort(list(i)), ',') AS flags, bool_or(i = 'DISPLAY_NAME_EMBEDDED_EMAIL_SPOOF') AS h FROM i GROUP BY 1)
SELECT message_key, score, flags, CASE WHEN score >= 60 OR h THEN 'CRITICAL_BEC' WHEN score >= 40 THEN 'HIGH_RISK' WHEN score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS level FROM g"""
SQL["stream_brute_force"] = f"SELECT \"user\", day AS start, failures, compromised FROM ({SQL['brute_force_windowed']})"
SQL["stream_impossible_travel"] = f"""WITH t AS ({SQL['impossible_travel']}) SELECT "user"::VARCHAR AS "user", country::VARCHAR AS country, next_country::VARCHAR AS next_country, ts, next_ts, seconds FROM t"""
SQL["stream_beacons"] = """WITH g AS (SELECT user_id::VARCHAR AS apex, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000 AS gap FROM events), a AS (SELECT apex, count(*) AS gaps, avg(gap) AS m, stddev_pop(gap) AS s FROM g WHERE gap > 0.05 GROUP BY 1)
  SELECT apex, gaps, round(m, 2) AS mean_gap, round(greatest(0.0, least(1.0, 1 - s / m)), 3) AS regularity FROM a WHERE gaps >= 4"""
SQL["stream_flow_sessions"] = f"""WITH {E}, p AS (SELECT 'k' || (k % 4) AS low, 'u' || user_id AS high, ts FROM e), g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS cut FROM p WINDOW w AS (PARTITION BY low, high ORDER BY ts)),
  s AS (SELECT *, sum(cut) OVER (PARTITION BY low, high ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT low, high, min(ts) AS start, count(*) AS packets FROM s GROUP BY low, high, n"""
SQL["stream_first_seen"] = f"WITH {E} SELECT DISTINCT event_type AS ioc_type, 'k' || k AS value FROM e"
SQL["stream_matched"] = f"WITH {E} SELECT event_id, k::VARCHAR AS value FROM e WHERE k IN (0, 7, 14, 21, 28)"
SQL["stream_near_alerts"] = "SELECT a.event_id AS alert_id, a.user_id AS \"user\", b.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) < 600 * 1000000"
_FACTORS = ", ".join(f"('{v}', '{f}', {p}::DOUBLE, '{x}')" for v, fs in risk.FACTORS.items() for f, (p, x) in fs.items())
SQL["message_factors"] = f"""WITH {E}, t(vector, factor, points, severity) AS (VALUES {_FACTORS}), f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'AUTHENTICATION' WHEN 'click' THEN 'PHISHING_URL' WHEN 'purchase' THEN 'BEC_SOCIAL_ENGINEERING' WHEN 'view' THEN 'ATTACHMENT_MALWARE' ELSE 'OBFUSCATION_TRANSIT' END AS vector,
    CASE event_type WHEN 'error' THEN CASE WHEN k < 30 THEN 'SPF_FAIL' ELSE 'DMARC_FAIL' END WHEN 'click' THEN 'IP_HOST_URL' WHEN 'purchase' THEN 'VIP_IMPERSONATION' WHEN 'view' THEN CASE WHEN k < 50 THEN 'macro' ELSE 'unknown' END ELSE 'ZERO_WIDTH' END AS factor, max((k // 10) / 10) AS c FROM e GROUP BY ALL)
  SELECT user_id, vector, factor, points, severity FROM f JOIN t USING (vector, factor) UNION ALL SELECT user_id, vector, factor, round(c * 15, 1), CASE WHEN c >= 0.9 THEN 'CRITICAL' ELSE 'HIGH' END FROM f WHERE vector = 'BEC_SOCIAL_ENGINEERING'"""
SQL["metadata_scores"] = """WITH d AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS c, o_orderdate::TIMESTAMP + to_days(((o_orderkey % 9) - 2)::INT) AS m FROM orders), a AS (SELECT o_orderkey, (greatest(c, m) > TIMESTAMP '1997-01-02')::INT AS f, (m < c)::INT + (least(c, m) < TIMESTAMP '1980-01-01')::INT AS o FROM d), s AS (SELECT o_orderkey, least(100, 35 * f + 20 * o) AS score, f FROM a WHERE f + o > 0)
  SELECT o_orderkey, score, CASE WHEN f > 0 OR score >= 75 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN score >= 15 THEN 'LOW' ELSE 'CLEAN' END AS severity FROM s"""
SQL["message_lifecycle"] = f"""WITH {HOPS} SELECT o_orderkey AS entity, o_orderdate::TIMESTAMP AS ts, 'client' AS source, 'SENT' AS event, '' AS ref FROM orders UNION ALL SELECT message_key, ts, 'relay', 'RECEIVED', hop || ' h' FROM h WHERE ts IS NOT NULL
  UNION ALL SELECT o_orderkey, (o_orderdate::DATE + 1)::TIMESTAMP, 'dkim', 'SIGNED', 'd' || o_custkey % 5 FROM orders WHERE o_orderkey % 3 <> 1 UNION ALL SELECT o_orderkey, (o_orderdate::DATE + 30)::TIMESTAMP, 'dkim', 'EXPIRES', 'd' || o_custkey % 5 FROM orders
  UNION ALL SELECT DISTINCT l_orderkey, (l_shipdate::DATE + 3)::TIMESTAMP, 'attachment', 'MODIFIED', 'p' || l_partkey FROM lineitem UNION ALL SELECT o_orderkey, (o_orderdate::DATE + 90)::TIMESTAMP, 'ingest', 'INGESTED', '' FROM orders"""
SQL["alert_indicators"] = f"WITH {E} SELECT 'USER:' || user_id AS indicator FROM e WHERE event_type = 'error' AND value > 90 UNION SELECT 'IP:' || k FROM e WHERE event_type = 'error' AND value > 90 AND k % 2 = 0"
SQL["process_evidence"] = f"WITH {E}, b AS (SELECT DISTINCT user_id FROM e WHERE value > 99.5) SELECT DISTINCT CASE event_type WHEN 'click' THEN 'hash' WHEN 'view' THEN 'egress' ELSE 'file' END AS kind, event_type || '-' || k AS value FROM e JOIN b USING (user_id) WHERE event_type IN ('click', 'view', 'signup')"

SQL["stream_password_spray"] = f"""WITH {LOGONS} SELECT source_ip, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS failures, true AS possible FROM l WHERE NOT success AND source_ip IS NOT NULL GROUP BY 1, 2"""
