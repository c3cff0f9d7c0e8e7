"""Process events: lineage joins and command-line rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import scans
from .alerts import rules

# Parents and children of suspicious spawns.
OFFICE_PARENTS = ["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "eqnedt32.exe", "mspub.exe", "visio.exe"]
WEB_PARENTS = ["w3wp.exe", "httpd.exe", "nginx.exe", "tomcat.exe", "tomcat8.exe", "tomcat9.exe", "tomcat10.exe", "java.exe", "php-cgi.exe", "php.exe", "node.exe"]
SERVICE_PARENTS = ["spoolsv.exe", "services.exe", "smss.exe", "lsass.exe", "csrss.exe"]
SHELLS = ["cmd.exe", "powershell.exe", "pwsh.exe", "cscript.exe", "wscript.exe", "mshta.exe", "certutil.exe", "bitsadmin.exe", "rundll32.exe", "regsvr32.exe", "curl.exe", "vssadmin.exe", "schtasks.exe", "whoami.exe", "net.exe", "net1.exe", "ipconfig.exe", "bash.exe", "sh.exe"]

# Tool, severity, technique, and arguments that make its use suspicious.
TOOL_RULES = [
    ("certutil", "HIGH", "T1105", ["-urlcache", "-split", "http://", "https://", "-decode"]),
    ("mshta", "HIGH", "T1218.005", ["javascript:", "vbscript:", "http://", "https://", "about:"]),
    ("regsvr32", "HIGH", "T1218.010", ["/s", "/u", "/i:http", "scrobj.dll"]),
    ("rundll32", "HIGH", "T1218.011", ["javascript:", "url.dll", "shellexec_run", "temp\\", "appdata\\"]),
    ("bitsadmin", "MEDIUM", "T1197", ["/transfer", "/create", "/addfile", "http://", "https://"]),
]
ENCODED_FLAGS = ["-enc", "-encodedcommand", "-e ", "-ec ", "downloadstring", "downloadfile", "invoke-webrequest", "invoke-expression", "iex(", "iex ", "frombase64string", "-w hidden", "-windowstyle hidden", "-ep bypass", "-executionpolicy bypass"]
DUMP_WORDS = ["lsass", "comsvcs.dll", "minidump", "mimikatz", "sekurlsa", "ntdsutil", "logonpasswords"]
DUMP_TOOLS = ["procdump", "rundll32", "mimikatz", "powershell", "cmd", "ntdsutil"]


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def process_rules(processes: DataFrame, keep: list[str]) -> DataFrame:
    """rule, severity, mitre for each rule that a process (image, command_line, parent_image) fulfils."""
    name, parent, cmd = base_name(F.col("image")), base_name(F.col("parent_image")), F.lower(F.coalesce("command_line", F.lit("")))
    shadow = (
        (F.contains(name, F.lit("vssadmin")) & has(cmd, ["delete"]) & has(cmd, ["shadows"]))
        | (F.contains(name, F.lit("wmic")) & has(cmd, ["shadowcopy"]) & has(cmd, ["delete"]))
        | (F.contains(name, F.lit("wbadmin")) & has(cmd, ["delete"]))
        | (F.contains(name, F.lit("bcdedit")) & has(cmd, ["recoveryenabled"]) & has(cmd, ["no"]))
    )
    table = [
        ("OFFICE_MACRO_SPAWN", "CRITICAL", "T1204.002", parent.isin(OFFICE_PARENTS) & (name.isin(SHELLS) | has(name, ["cmd", "powershell", "wscript", "cscript", "mshta", "certutil"]))),
        ("WEB_SHELL_SPAWN", "CRITICAL", "T1505.003", parent.isin(WEB_PARENTS) & (name.isin(SHELLS) | has(name, ["cmd", "powershell", "whoami", "net", "bash", "sh"]))),
        ("SUSPICIOUS_SERVICE_SPAWN", "CRITICAL", "T1059", parent.isin(SERVICE_PARENTS) & name.isin("cmd.exe", "powershell.exe", "pwsh.exe")),
        *((f"LOLBAS_{tool.upper()}", severity, mitre, F.contains(name, F.lit(tool)) & has(cmd, words)) for tool, severity, mitre, words in TOOL_RULES),
        ("SHADOW_COPY_DELETION", "CRITICAL", "T1490", shadow),
        ("ENCODED_COMMAND", "HIGH", "T1059.001", has(name, ["powershell", "pwsh"]) & has(cmd, ENCODED_FLAGS)),
        ("CREDENTIAL_DUMPING", "CRITICAL", "T1003", has(cmd, DUMP_WORDS) & has(name, DUMP_TOOLS)),
    ]
    return rules(processes, table, keep)


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, out: str) -> DataFrame:
    """left with `out`: value of the latest right row of the same keys with ts at or before its own.

    A union and one running last value, so a busy key costs a sort, never a product, and beyond a size is cut into runs. Equal right times go to the larger value.
    """
    none = F.lit(None)
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", none.cast(dict(right.dtypes)[value])).unionByName(
        right.select(*by, ts, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    return scans.last_known(both, by, [ts, "_side", "_value"], "_value", out).filter("_side = 1").drop("_side", "_value")


def parents(processes: DataFrame) -> DataFrame:
    """processes (host, guid, pid, parent_guid, parent_pid, ts) with parent: by guid, else the latest process of that pid started by then."""
    known = processes.filter("guid is not null").select(F.col("guid").alias("_guid")).distinct()
    joined = processes.join(known, (F.col("parent_guid") == F.col("_guid")) & (F.col("parent_guid") != F.col("guid")), "left").withColumnRenamed("_guid", "parent")
    some = F.col("parent").isNull() & F.col("parent_pid").isNotNull()  # only these are looked up; a pid that is unknown is nobody's
    mine = joined.filter(some).drop("parent").withColumn("_pid", F.col("parent_pid"))
    late = as_of(mine, processes.filter("pid is not null").select("host", F.col("pid").alias("_pid"), "ts", F.col("guid").alias("_parent")), ["host", "_pid"], "ts", "_parent", "_by_pid")
    by_pid = F.when(F.col("_by_pid") != F.col("guid"), F.col("_by_pid"))
    return joined.filter(~some).unionByName(late.withColumn("parent", by_pid).drop("_pid", "_by_pid"))


def attached(events: DataFrame, processes: DataFrame, by: list[str], ts: str, value: str, out: str, guid: str | None = None) -> DataFrame:
    """The process of each event: by guid, where both sides have the column and it names one; else the latest of these keys started by then; else the first of these keys. Of processes with one guid the latest counts."""
    first = processes.groupBy(*by).agg(F.min_by(value, F.struct(ts, value)).alias("_first"))
    found = as_of(events, processes.drop(guid) if guid else processes, by, ts, value, out).join(first, by, "left").withColumn(out, F.coalesce(out, "_first")).drop("_first")
    if guid is None:
        return found
    named = processes.filter(F.col(guid).isNotNull() & (F.col(guid) != "")).groupBy(guid).agg(F.max_by(value, F.struct(ts, value)).alias("_named"))
    return found.join(named, guid, "left").withColumn(out, F.coalesce("_named", out)).select(*events.columns, out)


def depths(edges: DataFrame) -> DataFrame:
    """node, depth from edges (node, parent): roots have depth 0, nodes on a cycle or below one null.

    Pointers double each round, so a chain of n takes log n rounds; each round is staged and reads the one before
    once a side. Rounds end when no pointer is left, or those left all lie on cycles.
    """
    at = edges.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    left = n = at.count()
    at, reach = staged(at, "depths"), 1
    while left and reach <= n:
        far = at.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        at = at.join(far, F.col("up") == F.col("_n"), "left").select("node", F.when(F.col("_n").isNotNull(), F.col("_up")).alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
        at, reach = staged(at, "depths"), 2 * reach
        left = at.filter("up is not null").count()
    return at.select("node", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def evidence(anomalies: DataFrame, hashes: DataFrame, connections: DataFrame, files: DataFrame) -> DataFrame:
    """kind, value of what anomalous processes (guid) left: their hashes (guid, value), egress (guid, value) and dropped files (guid, value)."""
    bad = anomalies.select("guid").distinct()
    one = lambda df, kind: df.join(bad, "guid", "left_semi").select(F.lit(kind).alias("kind"), "value")
    return one(hashes, "hash").unionByName(one(connections, "egress")).unionByName(one(files, "file")).distinct()
