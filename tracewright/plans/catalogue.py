"""Each operator as a query over the given tables.

The tables stand in for evidence: `events` for logons, processes, audit records and packets, `documents` and
`pages` for text, links and names, `orders` and `lineitem` for routes and timelines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, streaming
from ..functions import domains, network, text
from ..operators import alerts, auth_logs, cloud, custody, dns, enrich, flows, hidden, iocs, lists, messages, processes, risk, routes, rules, timeline
from ..operators import files as triage

from ..staging import folder

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def logons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures, purchases successes; the source is the key of the properties."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
    return e.select("ts", F.col("event_id").alias("record_id"), F.col("user_id").cast("string").alias("user"), F.col("k").cast("string").alias("source_ip"), (F.col("event_type") == "purchase").alias("success"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From users to keys: u1 -> k2; the ports are of the ids."""
    e = events(spark, sf_dir)
    ends = {"src": F.concat(F.lit("u"), "user_id"), "src_port": (F.col("user_id") % 7 + 1330).cast("int"), "dst": F.concat(F.lit("k"), "k"), "dst_port": (F.col("k") % 5 + 440).cast("int")}
    swap = F.col("event_type") == "view"
    other = {"src": "dst", "src_port": "dst_port", "dst": "src", "dst_port": "src_port"}
    return e.select(F.col("event_id").alias("packet_num"), "ts", F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("wire_len"), *(F.when(swap, ends[other[n]]).otherwise(c).alias(n) for n, c in ends.items()))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", domains.host(F.col("url")).alias("name"))


# Logons


@query
def brute_force(spark, sf_dir):
    found = auth_logs.brute_force(logons(spark, sf_dir), threshold=18)
    return found.select("user", "failures", "first_failure", "last_failure", "compromised", "severity", F.size("record_ids").cast("long").alias("evidence"), alerts.severity_points(F.col("severity")).alias("points"))


@query
def brute_force_windowed(spark, sf_dir):
    found = auth_logs.brute_force(logons(spark, sf_dir), threshold=3, window_seconds=86400)
    return found.select("user", F.col("window").alias("day"), "failures", "compromised", "severity")


@query
def password_spray(spark, sf_dir):
    found = auth_logs.password_spray(logons(spark, sf_dir), threshold=22)
    return found.select("source_ip", "users", "failures", "first_failure", "last_failure", F.array_join("names", ",").alias("names"), "severity")


@query
def alert_score(spark, sf_dir):
    found = auth_logs.brute_force(logons(spark, sf_dir), threshold=18)
    a = alerts.alert(found, "BRUTE_FORCE", F.col("severity"), "T1110", "failed logons", ts="first_failure", actor="user", evidence_count="failures", record_ids="record_ids")
    return alerts.scored(a, "actor")


@query
def special_logons(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type in ('purchase', 'signup')")
    kind, ok = (F.col("k") % 10).cast("int"), F.col("event_type") == "purchase"
    hash_ = auth_logs.pass_the_hash(kind, F.lit("x"), F.when(F.col("user_id") % 2 == 0, "NTLM").otherwise("Kerberos"), F.lit("10.0.0.1"), ok)
    return e.select("event_id", "user_id", F.when(hash_, "PASS_THE_HASH").when(auth_logs.cleartext_logon(kind, ok), "CLEARTEXT_LOGON").alias("alert_type"), auth_logs.named(kind, auth_logs.LOGON_TYPES).alias("logon_type")).filter("alert_type is not null")


@query
def suspicious_services(spark, sf_dir):
    part = F.create_map(*(F.lit(x) for x in (0, "C:\\Windows\\System32\\svchost.exe", 1, "powershell -enc AAAA", 2, "C:\\Users\\Public\\run.bat", 3, "C:\\ProgramData\\x.exe", 4, "mshta C:\\Temp\\a.hta")))
    e = events(spark, sf_dir).filter("event_type = 'signup'").withColumn("command", F.element_at(part, (F.col("k") % 5).cast("int")))
    return auth_logs.suspicious_commands(e, "command").select("event_id", "command", F.array_join("reasons", ",").alias("reasons"), "severity")


@query
def priv_after_create(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("user", F.col("user_id").cast("string"))
    made, granted = e.filter("event_type = 'signup' and value < 30"), e.filter("event_type = 'purchase' and value > 80")
    return auth_logs.privileged_after_creation(made, granted.select("event_id", "user")).select("event_id", "user", "created_in_log", "severity")


# Aggregates


@query
def events_by_type(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def family_totals(spark, sf_dir):
    t = F.col("event_type")
    return events(spark, sf_dir).agg(F.count_if(t == "error").alias("failed"), F.count_if(t == "purchase").alias("succeeded"), F.count_if(t.isin("click", "view")).alias("browsing"), F.count("*").alias("total"))


@query
def span_by_user(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1000000).alias("seconds"))


@query
def distinct_sets(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_set("k")), lambda x: x.cast("string")), ",").alias("keys"), F.countDistinct("user_id").alias("users"))


@query
def nx_rate(spark, sf_dir):
    return dns.failure_rate(events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), "user_id", "failed", least=10, rate=0.25)


# Windows and time


@query
def impossible_travel(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("record_id"), (F.col("k") % 7).alias("country")).withColumnRenamed("user_id", "user")
    return cloud.impossible_travel(e).select("user", "ts", "next_ts", "country", "next_country", "seconds", "record_id", "next_record_id")


@query
def beaconing(spark, sf_dir):
    return dns.beaconing(events(spark, sf_dir).withColumnRenamed("user_id", "apex"))


def _hops(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("d"))
    return li.select(F.col("l_orderkey").alias("message_key"), F.col("l_linenumber").cast("int").alias("hop"), F.when(F.col("l_linenumber") % 5 != 0, F.col("d").cast("timestamp")).alias("ts"), F.concat(F.lit("203.0.113."), F.col("l_linenumber").cast("string")).alias("from_ip"))


@query
def hop_delays(spark, sf_dir):
    return routes.hop_delays(_hops(spark, sf_dir)).select("message_key", "hop", "delay", "skewed", "late")


@query
def time_travel(spark, sf_dir):
    return routes.time_travel(_hops(spark, sf_dir)).filter("travels").select("message_key", "hop", "passed")


@query
def route_origins(spark, sf_dir):
    hops = routes.hop_delays(_hops(spark, sf_dir)).withColumn("from_ip", F.when(F.col("hop") % 2 == 0, F.concat(F.lit("8.8.8."), F.col("hop").cast("string"))).otherwise(F.col("from_ip")))
    return routes.origins(hops)


def _timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("orders").alias("source"), F.col("o_orderstatus").alias("event"), F.col("o_orderkey").cast("string").alias("ref"))
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("entity"), "ts", F.lit("events").alias("source"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("ref"))
    return timeline.union(o, e)


@query
def timeline_union(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query
def timeline_delta(spark, sf_dir):
    return timeline.deltas(_timeline(spark, sf_dir)).select("entity", "ts", "source", "ref", "delta", "delta_text", "excessive")


@query
def alert_band_tag(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.filter("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "user_id", F.col("ts").alias("alert_ts"))
    return timeline.tagged(a, e.filter("event_type <> 'error'").select("event_id", "user_id", "ts"), "user_id", 600).select("alert_id", "user_id", "event_id")


# Processes


@query
def asof_parent(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return processes.as_of(left, e.filter("event_type = 'signup'").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", "parent").select("event_id", "user_id", "parent")


@query
def event_attach_fallback(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return processes.attached(left, e.filter("event_type = 'signup'").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", "process").select("event_id", "user_id", "process")


@query
def event_attach_guid(spark, sf_dir):
    """As event_attach_fallback, but by guid first: of events and processes of one name, some of which no process has."""
    e = events(spark, sf_dir).withColumn("guid", F.concat(F.lit("g"), (F.col("event_id") % 211).cast("string")))
    left = e.filter("event_type = 'view'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 > 0, F.col("guid")).otherwise("").alias("guid"))
    return processes.attached(left, e.filter("event_type = 'signup' and event_id % 5 < 3").select("user_id", "ts", "event_id", "guid"), ["user_id"], "ts", "event_id", "process", "guid").select("event_id", "user_id", "process")


@query
def process_depth(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_id > 0")
    return processes.depths(e.select(F.col("event_id").alias("node"), F.when(F.col("event_id") > 1, F.floor(F.col("event_id") / 2)).alias("parent")))


_IMAGES = ["C:\\Windows\\cmd.exe", "C:\\Windows\\System32\\certutil.exe", "powershell.exe", "C:\\Tools\\notepad.exe", "rundll32.exe", "vssadmin.exe", "mshta.exe", "regsvr32.exe", "bitsadmin.exe", "wmic.exe", "wbadmin.exe", "bcdedit.exe", "procdump64.exe", "whoami.exe", "bash.exe"]
_PARENTS = ["C:\\Office\\WINWORD.EXE", "w3wp.exe", "explorer.exe", "services.exe", "spoolsv.exe", "java.exe", "EXCEL.EXE"]
_COMMANDS = ["run /c dir", "-urlcache http://x", "-enc AAAA", "delete shadows /all", "comsvcs.dll minidump lsass", "javascript:alert(1)", "/s /u /i:http://x scrobj.dll", "/transfer job http://x y", "shadowcopy delete", "delete catalog -quiet", "/set {default} recoveryenabled no", "-ep bypass iex(1)", "url.dll,openurl"]


@query
def process_rules(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    p = events(spark, sf_dir).select("event_id", pick(_IMAGES, F.col("k")).alias("image"), pick(_PARENTS, F.col("user_id")).alias("parent_image"), pick(_COMMANDS, F.col("event_id")).alias("command_line"))
    return processes.process_rules(p, ["event_id"])


# Cloud


@query
def audit_rules(spark, sf_dir):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("k")
    r = events(spark, sf_dir).select(
        "event_id", pick(["New-InboxRule", "Add-MailboxPermission", "Consent to application.", "assign_role", "UserLoggedIn"], F.col("event_id")).alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@corp.com")).alias("user"),
        pick(["x@evil.com; y@corp.com", "", "none"], k).alias("forward_to"), pick(["RSS Feeds", "Inbox"], k).alias("folder"), (k % 3 == 0).alias("delete_message"), (k % 2 == 0).alias("mark_read"), pick(["invoice", "lunch"], F.col("user_id")).alias("keywords"),
        pick(["FullAccess", "ReadPermission"], k).alias("access"), pick(["a@notcorp.com", "b@corp.com"], F.col("user_id")).alias("trustee"), pick(["Mail.Read offline_access", "openid"], k).alias("scopes"),
    )
    return cloud.audit_rules(r, ["event_id"])


# Flows


@query
def flow_table(spark, sf_dir):
    f = flows.flows(packets(spark, sf_dir))
    return f.select(F.col("low.host").alias("low"), F.col("high.host").alias("high"), F.col("low.port").alias("low_port"), F.col("high.port").alias("high_port"), "packets", "bytes", "forward", "reverse", F.col("client.src").alias("client"), "first_ts", "last_ts")


@query
def flow_enriched(spark, sf_dir):
    p = packets(spark, sf_dir)
    f = flows.flows(p)
    hosts = p.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    n = F.substring("host", 2, 20).cast("int")
    intel = hosts.withColumns({"country": F.concat(F.lit("c"), (n % 4).cast("string")), "tag": F.when(n % 3 == 0, "CLOUD"), "is_anonymous": n % 11 == 0})
    e = flows.enriched(f, intel)
    return e.select(F.col("low.host").alias("low"), F.col("high.host").alias("high"), F.col("low.port").alias("low_port"), F.col("high.port").alias("high_port"), "packets", "low_country", "low_tag", "high_country", "high_is_anonymous")


@query
def top_talkers(spark, sf_dir):
    return flows.top_talkers(packets(spark, sf_dir))


@query
def top_ports(spark, sf_dir):
    return flows.top_ports(packets(spark, sf_dir))


@query
def capture_risk(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("day", F.to_date("ts"))
    anonymous = p.select(F.col("src").alias("host")).filter("host in ('k7', 'u3')")
    return flows.capture_risk(p.withColumn("src_port", F.when(F.col("src_port") == 1336, 1337).otherwise(F.col("src_port"))), anonymous, "day").select(F.col("day").cast("string").alias("day"), "anonymous", "suspicious_port", "score", "verdict")


# Addresses and names


def _ips(spark, sf_dir):
    found = iocs.extract(table(spark, sf_dir, "documents"), "text", ["doc_id"], ["ipv4"])
    return found.select("doc_id", F.col("value").alias("ip"), network.ip_number(F.col("value")).alias("number"))


@query
def cidr_enrich(spark, sf_dir):
    cidrs = spark.createDataFrame([(f"{i * 16}.0.0.0/4", f"net{i}") for i in range(16)] + [("97.51.0.0/16", "narrow")], "cidr string, net string")
    return enrich.in_range(_ips(spark, sf_dir), enrich.cidr_ranges(cidrs), "number", ["net"]).select("doc_id", "ip", "net")


@query
def tor_flag(spark, sf_dir):
    n = F.col("number")
    return _ips(spark, sf_dir).select("doc_id", "ip", network.is_tor(n).alias("is_tor"), network.is_private(n).alias("is_private"), network.subnet24(n).alias("subnet"))


@query
def ip_risk(spark, sf_dir):
    n = F.col("number")
    asn = F.when(n % 3 == 0, 16509).when(n % 3 == 1, 9009)
    org = F.when(n % 5 == 0, "Hetzner Online")
    return _ips(spark, sf_dir).select("doc_id", "ip", enrich.ip_risk(n, asn, org).alias("risk"), enrich.provider(asn, org).alias("provider"))


@query
def lookalike_domains(spark, sf_dir):
    names = page_hosts(spark, sf_dir).select(domains.registered_domain(F.col("name")).alias("apex"), F.substring_index("name", ".", 1).alias("name")).select("name")
    protected = spark.createDataFrame([(x,) for x in ("ththre", "thther", "erenan", "within", "theand", "nicht")], "target string")
    return enrich.lookalikes(names, protected)


# URLs and names


@query
def url_features(spark, sf_dir):
    u = F.col("url")
    h = domains.host(u)
    return table(spark, sf_dir, "pages").select("page_id", domains.scheme(u).alias("scheme"), h.alias("host"), domains.registered_domain(h).alias("apex"), domains.subdomain(h).alias("sub"), domains.tld(h).alias("tld"), F.size(domains.query_keys(u)).alias("parameters"), domains.is_ip_host(h).alias("is_ip"))


@query
def url_score(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", domains.url_score(F.col("url")).alias("score"))


@query
def defang_roundtrip(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", domains.defanged(u).alias("defanged"), domains.refanged(domains.defanged(u)).alias("refanged"))


@query
def anchor_links(spark, sf_dir):
    found = messages.links(table(spark, sf_dir, "pages").withColumn("text", F.lit("")), "page_id", "html", "text")
    return found.filter("origin = 'a'").select("page_id", "url", "anchor")


@query
def link_reports(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.substring_index(domains.host(F.col("url")), ".", -2).alias("site"), "url").withColumn("anchor", F.lit(None).cast("string"))
    return messages.link_report(p, "site").select("site", "links", "domains", F.array_join("flags", ",").alias("flags"), "score", "verdict")


@query
def html_comments(spark, sf_dir):
    found = hidden.content(table(spark, sf_dir, "pages").withColumn("text", F.lit("")), "page_id", "html", "text", least_comment=3)
    return found.filter("kind = 'HTML_COMMENT'").groupBy("page_id").agg(F.count("*").alias("comments"), F.max(F.length("evidence")).alias("longest"))


@query
def text_entropy(spark, sf_dir):
    return page_hosts(spark, sf_dir).select("page_id", text.entropy(F.col("name")).alias("entropy"))


@query
def dga_score(spark, sf_dir):
    label = F.substring_index(F.col("name"), ".", 1)
    return page_hosts(spark, sf_dir).select("page_id", F.round(text.vowel_share(label), 4).alias("vowels"), text.longest_consonants(label).alias("consonants"), text.generated_score(label).alias("score"))


@query
def subdomain_check(spark, sf_dir):
    sub = domains.subdomain(F.col("name"))
    return page_hosts(spark, sf_dir).select("page_id", sub.alias("sub"), F.length(sub).alias("n"), text.covert_subdomain(sub).alias("suspicious"))


@query
def encoding_class(spark, sf_dir):
    return page_hosts(spark, sf_dir).select("page_id", text.encoding_class(F.substring_index("name", ".", 1)).alias("kind"))


@query
def dns_tunnel_like(spark, sf_dir):
    q = page_hosts(spark, sf_dir).select(F.concat(F.md5(F.col("url").cast("binary")), F.lit("."), "name").alias("name"), F.when(F.col("page_id") % 3 == 0, "TXT").otherwise("A").alias("rtype"))
    return dns.tunnelling(q).select("apex", "queries", "names", "entropic", "longest", "bytes", "signs", "severity")


@query
def fast_flux_like(spark, sf_dir):
    a = _ips(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("domain"), "ip", (F.col("number") % 600).alias("ttl"))
    ns = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("ns"))
    return dns.fast_flux(a, ns)


# Indicators and text


@query
def hash_watchlist(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    digests = custody.digests(F.col("text"))
    hashes = d.select("doc_id", F.explode(F.array(digests["md5"], digests["sha256"])).alias("value"))
    watch = d.filter("length(text) < 100").select(digests["sha256"].alias("value"))
    return lists.listed(hashes, watch).select("doc_id", "value").distinct()


@query
def ioc_extract(spark, sf_dir):
    found = iocs.extract(table(spark, sf_dir, "documents"), "text", ["doc_id"], ["ipv4", "email", "md5", "sha1", "sha256", "eth"])
    return found.groupBy("doc_id", "ioc_type", "value").agg(F.count("*").alias("n"), iocs.level(F.first(iocs.risk(F.col("ioc_type")))).alias("severity"))


@query
def secret_leaks(spark, sf_dir):
    found = table(spark, sf_dir, "documents").withColumn("secret", F.explode(F.regexp_extract_all("text", F.lit('token = "([0-9a-f]+)"'), F.lit(1))))
    return found.select("doc_id", text.masked(F.col("secret")).alias("masked"), F.length("secret").alias("n"))


def _sightings(spark, sf_dir):
    one = lambda t, key, col: iocs.extract(table(spark, sf_dir, t), col, [F.concat_ws("-", F.lit(t), F.col(key).cast("string")).alias("item")], ["ipv4", "email", "sha1"])
    return timeline.union(one("documents", "doc_id", "text"), one("pages", "page_id", "html"), one("benchmark", "item_id", "text"))


@query
def shared_ioc(spark, sf_dir):
    return iocs.shared(_sightings(spark, sf_dir), "item")


@query
def shared_ioc_rows(spark, sf_dir):
    return iocs.shared_rows(_sightings(spark, sf_dir), "item")


@query
def first_iocs(spark, sf_dir):
    return iocs.deduplicated(_sightings(spark, sf_dir), ["item", "value"]).select("item", "ioc_type", "value")


_TEXT_RULES = [
    ("licence", "any", "LOW", 10, [r"(?i)all rights reserved", r"(?i)general public license"]),
    ("credentials", "all", "HIGH", 40, [r"token = ", r"[0-9a-f]{40}"]),
    ("abuse", "2", "MEDIUM", 20, [r"(?i)\bstupid\b", r"(?i)\bpathetic\b", r"(?i)\bdisgusting\b", r"(?i)\btrash\b", r"(?i)\bidiot\b"]),
]


@query
def rule_scan_any_all(spark, sf_dir):
    return rules.scan(table(spark, sf_dir, "documents"), _TEXT_RULES, "text", ["doc_id"])


@query
def rule_attribution(spark, sf_dir):
    return rules.attributed(rules.scan(table(spark, sf_dir, "documents"), _TEXT_RULES, "text", ["doc_id"]), "doc_id")


@query
def prompt_injection_scan(spark, sf_dir):
    return rules.scan(table(spark, sf_dir, "pages"), [rules.PROMPT_INJECTION, rules.SCRIPT_PAYLOADS, *rules.FRAUD_WORDING], "html", ["page_id"])


@query
def zero_width(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.zero_width_count(F.col("text")).alias("n"), F.length(messages.without_hidden(F.col("text"))).alias("visible"))


@query
def encoded_blobs(spark, sf_dir):
    """Blobs in whole texts and in their encodings, which Spark breaks into lines."""
    encoded = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", encoded).alias("text"), F.lit("").alias("html"))
    return hidden.content(d, "doc_id", "html", "text").filter("kind = 'BASE64_TEXT'").select("doc_id", F.length("evidence").alias("n"), F.length("decoded").alias("chars"))


@query
def byte_entropies(spark, sf_dir):
    e = triage.byte_entropy(table(spark, sf_dir, "pages"), "html", ["page_id"])
    return e.select("page_id", F.round("entropy", 3).alias("entropy"), triage.entropy_tier(F.col("entropy")).alias("tier"))


@query
def file_types(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    body = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("MZ"), "html")).otherwise(F.col("html"))
    return p.select("page_id", triage.file_type(body).alias("kind"))


@query
def page_strings(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    chunks = p.select(F.col("page_id").alias("image_id"), F.lit(0).cast("long").alias("chunk_off"), F.col("html").cast("binary").alias("bytes"))
    return triage.string_statistics(triage.strings(chunks, 6))


# Risk, cases, custody


def _factors(spark, sf_dir):
    vectors = list(risk.CAPS)
    t = F.col("event_type")
    vector = F.when(t == "error", vectors[0]).when(t == "click", vectors[1]).when(t == "purchase", vectors[2]).when(t == "view", vectors[3]).otherwise(vectors[4])
    return events(spark, sf_dir).select("user_id", vector.alias("vector"), (F.col("k") / 8).alias("points"), F.when(F.col("k") > 80, "CRITICAL").otherwise("LOW").alias("severity"))


@query
def risk_vectors(spark, sf_dir):
    return risk.vector_scores(_factors(spark, sf_dir), "user_id")


@query
def risk_total(spark, sf_dir):
    return risk.totals(risk.vector_scores(_factors(spark, sf_dir), "user_id"), "user_id")


@query
def case_risk(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("source").alias("case_id"), (F.col("n_chars") % 101).cast("double").alias("risk_score"))
    linked = d.filter("lang = 'es'").select(F.col("source").alias("case_id"))
    return risk.case_risk(items, linked)


@query
def item_scores(spark, sf_dir):
    e = events(spark, sf_dir)
    t = F.col("event_type")
    kind = F.when(t == "error", "binary").when(t == "click", "capture").when(t == "view", "log").otherwise("memory")
    return e.select("event_id", risk.item_score(kind, F.col("k") > 80, F.col("k") > 50, F.col("k") % 5).alias("score"))


@query
def tactic_matrix(spark, sf_dir):
    t = F.col("event_type")
    technique = F.when(t == "error", "T1110.001").when(t == "click", "T1566.002").when(t == "purchase", "T1098").when(t == "view", "T1059.001").otherwise("T1999")
    return risk.tactic_matrix(events(spark, sf_dir).withColumn("mitre", technique))


@query
def manifest_digests(spark, sf_dir):
    return custody.manifest(table(spark, sf_dir, "documents"), "doc_id", "text").drop("sha512")


@query
def custody_verify(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    after = d.filter("doc_id % 7 <> 3").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return custody.verified(custody.manifest(d, "doc_id", "text"), custody.manifest(after, "doc_id", "text"), "doc_id")


@query
def ledger_state(spark, sf_dir):
    e = events(spark, sf_dir)
    action = F.when(F.col("event_type") == "error", "TAMPER_DETECTED").otherwise(F.upper("event_type"))
    return custody.ledger_state(e.select(F.col("user_id").cast("string").alias("evidence_id"), action.alias("action"), "ts", F.col("event_id").cast("string").alias("event_id")))


@query
def kill_chain(spark, sf_dir):
    e = events(spark, sf_dir)
    return risk.kill_chain(e.select(F.col("k").alias("case_id"), F.when(F.col("event_type") == "error", "email").when((F.col("event_type") == "purchase") & (F.col("value") > 95), "binary").otherwise("log").alias("kind")))


@query
def stix_patterns(spark, sf_dir):
    found = iocs.extract(table(spark, sf_dir, "documents"), "text", [], ["ipv4", "email", "sha1"]).distinct()
    return sinks.stix_indicators(found).select("stix_id", "ioc_type", "pattern")


@query
def ioc_ledger(spark, sf_dir):
    found = iocs.extract(table(spark, sf_dir, "documents"), "text", [F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("item_id")], ["ipv4", "email", "sha1"])
    return found.groupBy("case_id", "item_id", "ioc_type", "value").agg(F.first(iocs.level(iocs.risk(F.col("ioc_type")))).alias("severity"))


@query
def mail_fraud(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id")
    m = c.select(
        F.concat_ws("-", n.cast("string"), F.col("turn").cast("string")).alias("message_key"), F.when(n % 4 == 0, "Jane CEO").when(n % 4 == 1, "help@bank.com").otherwise("Bob").alias("display_name"),
        F.when(n % 3 == 0, "x@gmail.com").when(n % 3 == 1, "y@mailinator.com").otherwise("z@corp.co.uk").alias("from_address"), F.when(n % 5 == 0, "q@other.org").alias("reply_to"), F.when(n % 2 == 0, "z@mail.corp.co.uk").alias("return_path"), F.lit("").alias("subject"), F.col("text").alias("body"),
    )
    return messages.fraud_report(messages.sender_indicators(m, "message_key"), "message_key").select("message_key", "score", F.array_join("flags", ",").alias("flags"), "level")


@query
def message_factors(spark, sf_dir):
    t, k = F.col("event_type"), F.col("k")
    vector = F.when(t == "error", "AUTHENTICATION").when(t == "click", "PHISHING_URL").when(t == "purchase", "BEC_SOCIAL_ENGINEERING").when(t == "view", "ATTACHMENT_MALWARE").otherwise("OBFUSCATION_TRANSIT")
    factor = F.when(t == "error", F.when(k < 30, "SPF_FAIL").otherwise("DMARC_FAIL")).when(t == "click", "IP_HOST_URL").when(t == "purchase", "VIP_IMPERSONATION").when(t == "view", F.when(k < 50, "macro").otherwise("unknown")).otherwise("ZERO_WIDTH")
    return risk.factors(events(spark, sf_dir).select("user_id", vector.alias("vector"), factor.alias("factor"), (F.floor(k / 10) / 10).alias("confidence")), "user_id")


@query
def metadata_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made, changed = F.col("o_orderdate").cast("timestamp"), F.expr("cast(o_orderdate as timestamp) + make_interval(0, 0, 0, cast(o_orderkey % 9 as int) - 2)")
    found = triage.time_anomalies(o.select("o_orderkey", made.alias("created"), changed.alias("modified")), F.lit("1997-01-01").cast("timestamp"))
    return risk.metadata_score(found.select("o_orderkey", F.when(F.col("anomaly") == "FUTURE", "HIGH").otherwise("MEDIUM").alias("severity")), "o_orderkey")


@query
def message_lifecycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = lambda n: F.date_add(F.col("o_orderdate").cast("date"), n).cast("timestamp")
    key = F.col("o_orderkey").alias("message_key")
    m = o.select(key, F.col("o_orderdate").cast("timestamp").alias("date"), day(90).alias("ingest_ts"))
    hops = _hops(spark, sf_dir).withColumn("by_host", F.lit("h"))
    signed = o.select(key, F.concat(F.lit("d"), F.col("o_custkey") % 5).alias("domain"), F.when(F.col("o_orderkey") % 3 != 1, day(1)).alias("signed"), day(30).alias("expires"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_key"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("filename"), F.date_add(F.col("l_shipdate").cast("date"), 3).cast("timestamp").alias("modified")).distinct()
    return timeline.lifecycle(m, hops, signed, parts)


@query
def alert_indicators(spark, sf_dir):
    e = events(spark, sf_dir).filter("event_type = 'error' and value > 90")
    a = alerts.alert(e, "X", "HIGH", "T1110", "x", actor=F.col("user_id").cast("string"), source_ip=F.when(F.col("k") % 2 == 0, F.col("k").cast("string")))
    return iocs.from_alerts(a)


@query
def process_evidence(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("guid", F.col("user_id").cast("string"))
    one = lambda t: e.filter(F.col("event_type") == t).select("guid", F.concat(F.lit(t), F.lit("-"), F.col("k").cast("string")).alias("value"))
    return processes.evidence(e.filter("value > 99.5"), one("click"), one("view"), one("signup"))


# Streams: the table as a file source, all of it once, then the same rules as in batch.


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")  # a pattern, as a plain path would have to be a folder
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _stream_logons(spark, sf_dir):
    e = _stream(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
    return e.select("ts", F.col("user_id").cast("string").alias("user"), F.col("k").cast("string").alias("source_ip"), (F.col("event_type") == "purchase").alias("success"))


def _drained(spark, stream, mode, keys=None):
    return streaming.drained(stream, mode, folder(spark, "stream-state"), folder(spark, "stream-out"), keys)


@query
def stream_brute_force(spark, sf_dir):
    return _drained(spark, streaming.brute_force(_stream_logons(spark, sf_dir), 3, "1 day"), "complete").select("user", "start", "failures", "compromised")


@query
def stream_password_spray(spark, sf_dir):
    """Users are counted approximately: their number is kept out, and whether it is possible at all is shown."""
    found = _drained(spark, streaming.password_spray(_stream_logons(spark, sf_dir), 1, "1 day"), "complete")
    return found.select("source_ip", "start", "failures", F.col("users").between(1, F.col("failures")).alias("possible"))


@query
def stream_impossible_travel(spark, sf_dir):
    logins = _stream(spark, sf_dir).filter("event_type = 'signup'").select(F.col("user_id").cast("string").alias("user"), "ts", (F.col("k") % 7).cast("string").alias("country"))
    return _drained(spark, streaming.impossible_travel(logins), "append")


@query
def stream_beacons(spark, sf_dir):
    return _drained(spark, streaming.beacons(_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("apex"), "ts")), "update", ["apex"]).select("apex", "gaps", F.round("mean_gap", 2).alias("mean_gap"), F.round("regularity", 3).alias("regularity"))


@query
def stream_flow_sessions(spark, sf_dir):
    e = _stream(spark, sf_dir)
    p = e.select("ts", F.concat(F.lit("u"), "user_id").alias("src"), F.lit(1).alias("src_port"), F.concat(F.lit("k"), (F.col("k") % 4).cast("string")).alias("dst"), F.lit(2).alias("dst_port"), F.lit(1).alias("wire_len"))
    f = _drained(spark, streaming.flow_sessions(p, "6 hours"), "complete")
    return f.select(F.col("low.host").alias("low"), F.col("high.host").alias("high"), "start", "packets")


@query
def stream_first_seen(spark, sf_dir):
    seen = _stream(spark, sf_dir).select("ts", F.col("event_type").alias("ioc_type"), F.concat(F.lit(" K"), F.col("k").cast("string")).alias("value"))
    return _drained(spark, streaming.first_seen(seen), "append").select("ioc_type", "value")


@query
def stream_matched(spark, sf_dir):
    watch = spark.range(5).select((F.col("id") * 7).cast("string").alias("value"))
    return _drained(spark, streaming.matched(_stream(spark, sf_dir).select("event_id", F.col("k").cast("string").alias("value")), watch), "append").select("event_id", "value")


@query
def stream_near_alerts(spark, sf_dir):
    e = _stream(spark, sf_dir)
    a = e.filter("event_type = 'error'").select(F.col("event_id").alias("alert_id"), F.col("user_id").alias("user"), F.col("ts").alias("alert_ts"))
    r = _stream(spark, sf_dir).filter("event_type <> 'error'").select("event_id", F.col("user_id").alias("user"), "ts")
    return _drained(spark, streaming.near_alerts(a, r, 600), "append").select("alert_id", "user", "event_id")
