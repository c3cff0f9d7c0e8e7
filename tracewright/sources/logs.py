"""Event logs, cloud audit exports, and the dimension lists that detections use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import computed
from ..functions.maps import first_of_each, text_map
from . import nested, records

EVENTS = "event_id int, record_id bigint, ts timestamp, provider string, data map<string,string>"


def event_objects(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Events from rows with JSON objects; root values stand in for those that EventData lacks. Rows that hold none are left out: rejected_events has them."""
    obj = records.good(records.objects(rows, raw))
    text = lambda *paths: records.field("object", *paths)
    none = F.create_map().cast("map<string,string>")
    numbered = computed(obj, event_id=text("EventID", "System.EventID", "event_id").try_cast("int"))  # before the maps, so that filters on it come before them
    found = computed(numbered, _inner=F.coalesce(records.fields("object", ".EventData"), none), _root=F.coalesce(records.fields("object"), none))
    extra = F.map_filter("_root", lambda k, v: ~k.isin("EventData", "Event") & ~F.map_contains_key("_inner", k))
    return computed(found, data=F.map_concat("_inner", extra)).select(
        "event_id", text("RecordId", "EventRecordID", "record_id").try_cast("bigint").alias("record_id"),
        F.try_to_timestamp(text("Timestamp", "TimeCreated", "UtcTime", "ts")).alias("ts"), text("Provider", "ProviderName").alias("provider"), "data",
    )


def _event_texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    if lines:
        return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw"))
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    many = F.coalesce(F.from_json(F.when(F.col("value").startswith("["), F.col("value")), "array<string>"), F.from_json(F.get_json_object("value", "$.Events"), "array<string>"), F.filter(F.split("value", r"\r?\n(?=\s*\{\s*\")"), lambda x: F.length(F.trim(x)) > 0))
    return whole.select(F.explode(many).alias("raw"))


def read_event_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Lists, {"Events": [...]}, single objects, or one object a line. A file is one row; with `lines` each line is one, and files are split."""
    return event_objects(_event_texts(spark, path, lines))


def read_event_files(spark: SparkSession, path: str, block_bytes: int = nested.BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Events, and rejects (raw, reason), of files that are lists, {"Events": [...]}, or objects one after another; many tasks read a file, whatever its lines."""
    found = records.objects(nested.read_records(spark, path, ("Events",), block_bytes))
    return event_objects(found.select("raw")), records.rejects(found)


def rejected_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """raw, reason of the records that read_event_json leaves out."""
    return records.rejects(records.objects(_event_texts(spark, path, lines)))


def read_event_xml(spark: SparkSession, path: str) -> DataFrame:
    """<Event> blocks, with or without a namespace; System fields, named Data, and what UserData holds by its elements' names. Files are split where events end."""
    block = spark.read.option("lineSep", "</Event>").text(path).select(F.regexp_extract("value", r"(?s)<Event\b.*$", 0).alias("raw")).filter("raw <> ''")
    one = lambda p: F.regexp_extract("raw", p, 1)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    data = F.regexp_extract_all("raw", F.lit(r"(?s)<Data\s+Name\s*=\s*[\"'][^\"']+[\"']\s*>.*?</Data>"), F.lit(0))
    pairs = F.transform(data, lambda d: F.struct(F.regexp_extract(d, r"Name\s*=\s*[\"']([^\"']+)", 1).alias("k"), plain(F.regexp_extract(d, r"(?s)>(.*)</Data>", 1)).alias("v")))
    user = F.regexp_extract_all(F.regexp_extract("raw", r"(?s)<UserData\b[^>]*>(.*)</UserData>", 1), F.lit(r"<([\w:]+)(?:\s[^>]*)?>([^<]*)</"), F.lit(0))
    own = F.transform(user, lambda d: F.struct(F.regexp_extract(d, r"^<(?:\w+:)?(\w+)", 1).alias("k"), plain(F.regexp_extract(d, r">([^<]*)</", 1)).alias("v")))
    pairs = F.concat(pairs, own)
    return block.select(
        one(r"<EventID[^>]*>\s*(\d+)").try_cast("int").alias("event_id"), one(r"<EventRecordID[^>]*>\s*(\d+)").try_cast("bigint").alias("record_id"), F.try_to_timestamp(one(r"SystemTime\s*=\s*[\"']([^\"']+)")).alias("ts"),
        F.nullif(one(r"<Provider\s[^>]*Name\s*=\s*[\"']([^\"']+)"), F.lit("")).alias("provider"), first_of_each(pairs).alias("data"),
    )


def read_audit(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """raw JSON objects of audit exports: arrays, {"items"} or {"value"} envelopes, one object a line, or CSV with a header. A file is one row; with `lines` each line is one, and files are split."""
    if lines:
        return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw"))
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select(F.to_json(F.struct("*")).alias("raw"))
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    list_ = lambda c: F.from_json(c, "array<string>")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    many = F.coalesce(list_(F.when(F.col("value").startswith("["), F.col("value"))), list_(F.get_json_object("value", "$.items")), list_(F.get_json_object("value", "$.value")), lines)
    return whole.select(F.explode(many).alias("raw"))


def read_audit_files(spark: SparkSession, path: str, block_bytes: int = nested.BLOCK_BYTES) -> DataFrame:
    """raw JSON objects of arrays and {"items"} or {"value"} envelopes; many tasks read a file, whatever its lines."""
    return nested.read_records(spark, path, ("items", "value"), block_bytes).select("raw")


def numbers(value: Column) -> Column:
    """Decimal or 0x hexadecimal text as a long."""
    return F.when(F.lower(value).startswith("0x"), F.conv(F.substring(value, 3, 16), 16, 10).try_cast("bigint")).otherwise(value.try_cast("bigint"))


def process_events(events: DataFrame) -> DataFrame:
    """Process starts (event 1) with typed fields; hashes as a map from algorithm to digest."""
    d = lambda k: F.col("data")[k]
    return events.filter("event_id = 1").select(
        "record_id", "ts", d("ProcessGuid").alias("guid"), numbers(d("ProcessId")).alias("pid"), d("ParentProcessGuid").alias("parent_guid"), numbers(d("ParentProcessId")).alias("parent_pid"),
        d("Image").alias("image"), d("CommandLine").alias("command_line"), d("ParentImage").alias("parent_image"), d("User").alias("user"), text_map(d("Hashes"), ",", "=").alias("hashes"),
    )


def network_events(events: DataFrame) -> DataFrame:
    """Connections of processes (event 3); initiated as a boolean."""
    d = lambda k: F.col("data")[k]
    return events.filter("event_id = 3").select("record_id", "ts", d("ProcessGuid").alias("guid"), numbers(d("ProcessId")).alias("pid"), d("Image").alias("image"), F.lower(d("Protocol")).alias("protocol"), d("SourceIp").alias("source_ip"), numbers(d("SourcePort")).alias("source_port"), d("DestinationIp").alias("destination_ip"), numbers(d("DestinationPort")).alias("destination_port"), d("DestinationHostname").alias("destination_host"), (F.lower(d("Initiated")) == "true").alias("initiated"))


def image_loads(events: DataFrame) -> DataFrame:
    """Modules that processes load (event 7); signed as a boolean, hashes as a map."""
    d = lambda k: F.col("data")[k]
    return events.filter("event_id = 7").select("record_id", "ts", d("ProcessGuid").alias("guid"), numbers(d("ProcessId")).alias("pid"), d("Image").alias("image"), d("ImageLoaded").alias("loaded"), (F.lower(d("Signed")) == "true").alias("signed"), d("Signature").alias("signature"), text_map(d("Hashes"), ",", "=").alias("hashes"))


def file_events(events: DataFrame) -> DataFrame:
    """Files that processes create (event 11)."""
    d = lambda k: F.col("data")[k]
    return events.filter("event_id = 11").select("record_id", "ts", d("ProcessGuid").alias("guid"), numbers(d("ProcessId")).alias("pid"), d("Image").alias("image"), d("TargetFilename").alias("target"), F.try_to_timestamp(d("CreationUtcTime")).alias("created"))


def privilege_events(events: DataFrame) -> DataFrame:
    """Special privileges given to a logon (4672), listed."""
    d = lambda k: F.col("data")[k]
    listed = F.filter(F.split(F.coalesce(d("PrivilegeList"), F.lit("")), r"[\s,]+"), lambda x: x != "")
    return events.filter("event_id = 4672").select("record_id", "ts", d("SubjectUserName").alias("user"), d("SubjectLogonId").alias("logon_id"), listed.alias("privileges"))


def logon_events(events: DataFrame) -> DataFrame:
    """Logons: 4624 success, 4625 failure."""
    d = lambda k: F.col("data")[k]
    return events.filter("event_id in (4624, 4625)").select("record_id", "ts", d("TargetUserName").alias("user"), F.nullif(d("IpAddress"), F.lit("-")).alias("source_ip"), (F.col("event_id") == 4624).alias("success"), d("LogonType").try_cast("int").alias("logon_type"), d("LogonProcessName").alias("process"), d("AuthenticationPackageName").alias("package"), F.lower(d("SubStatus")).alias("sub_status"))


def account_events(events: DataFrame) -> DataFrame:
    """Accounts made (4720) and added to groups (4728, 4732, 4756); for additions the member is the account, the target the group."""
    d = lambda k: F.col("data")[k]
    made = F.col("event_id") == 4720
    return events.filter("event_id in (4720, 4728, 4732, 4756)").select("record_id", "ts", F.when(made, "created").otherwise("added").alias("action"), F.when(made, d("TargetUserName")).otherwise(F.coalesce(d("MemberName"), d("MemberSid"))).alias("user"), F.when(~made, d("TargetUserName")).alias("group"))


def service_events(events: DataFrame) -> DataFrame:
    """Services (7045, 4697) and tasks (4698, 4702) with their command; a task's from its XML, with any namespace."""
    d = lambda k: F.col("data")[k]
    xml = d("TaskContent")
    tag = lambda n: F.nullif(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{n}>(.*?)</", 1), F.lit(""))
    return events.filter("event_id in (7045, 4697, 4698, 4702)").select("record_id", "ts", F.when(F.col("event_id").isin(7045, 4697), "service").otherwise("task").alias("kind"), F.coalesce(d("ServiceName"), d("TaskName")).alias("name"), F.coalesce(d("ImagePath"), d("ServiceFileName"), F.concat_ws(" ", tag("Command"), tag("Arguments"))).alias("command"), F.coalesce(d("AccountName"), tag("UserId")).alias("account"))


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """value: one digest a line, lower case; lines with # are comments."""
    line = F.trim("value")
    return spark.read.text(path).select(F.lower(line).alias("value")).filter((F.length("value") > 0) & ~F.col("value").startswith("#")).distinct()


# Vendors and the hosts of their mail, where no list is given.
VENDORS = [("DocuSign", "*.docusign.net"), ("DocuSign", "*.mktomail.com"), ("Microsoft 365", "*.protection.outlook.com"), ("ADP Payroll", "*.adp.com")]


def read_watchlist(spark: SparkSession, path: str | None = None) -> dict[str, DataFrame]:
    """protected domains, executives (also by their aliases) and vendors of a JSON watch list; built-in ones without a path."""
    if path is None:
        from ..operators.enrich import PROTECTED

        return {
            "domains": spark.createDataFrame([(x,) for x in PROTECTED], "target string"),
            "executives": spark.createDataFrame([], "name string, address string"),
            "vendors": spark.createDataFrame(VENDORS, "vendor string, pattern string"),
        }
    raw = spark.read.text(path, wholetext=True)
    inner = lambda schema, *keys: raw.select(F.explode(F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{k}"), schema) for k in keys))).alias("x"))
    people = inner("array<struct<name:string,email:string,aliases:array<string>>>", "protected_executives", "executives")
    vendors = inner("array<struct<name:string,vendor_name:string,mx_patterns:array<string>,allowed_mx_patterns:array<string>>>", "trusted_partner_vendors", "vendors")
    return {
        "domains": inner("array<string>", "protected_domains").select(F.lower("x").alias("target")),
        "executives": people.select(F.explode(F.array_distinct(F.concat(F.array("x.name"), F.coalesce("x.aliases", F.array().cast("array<string>"))))).alias("name"), F.col("x.email").alias("address")),
        "vendors": vendors.select(F.coalesce("x.vendor_name", "x.name").alias("vendor"), F.explode(F.coalesce("x.allowed_mx_patterns", "x.mx_patterns")).alias("pattern")),
    }


def posture(records: DataFrame) -> DataFrame:
    """Per name its SPF, DMARC and BIMI texts (of the name itself, of _dmarc. and default._bimi. under it), MX and addresses, from DNS rows (name, rtype, value) instead of live queries."""
    kind, value = F.upper("rtype"), F.lower("value")
    owner = F.regexp_replace(F.lower("name"), r"^(_dmarc|default\._bimi)\.", "")
    listed = lambda when: F.sort_array(F.collect_set(F.when(when, F.col("value"))))
    text = lambda start: listed((kind == "TXT") & value.startswith(start))
    return records.groupBy(owner.alias("name")).agg(text("v=spf1").alias("spf"), text("v=dmarc1").alias("dmarc"), text("v=bimi1").alias("bimi"), F.sort_array(F.collect_set(F.when(kind == "MX", value))).alias("mx"), F.count_if(kind.isin("A", "AAAA")).alias("addresses"))
