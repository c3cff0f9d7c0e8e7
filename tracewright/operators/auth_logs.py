"""Logon detections over events (ts, record_id, user, source_ip, success)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import computed, let

# Words of suspicious service and task commands, and paths that users can write to.
EXEC_WORDS = ["powershell", "pwsh", "cmd.exe", "-enc", "-encodedcommand", "-w hidden", "-ep bypass", "downloadstring", "iex", "cscript", "wscript", "mshta", "certutil", "regsvr32", "rundll32", "bitsadmin", "vssadmin"]
WRITABLE_PATHS = ["appdata", "temp", "tmp", "users\\public", "perflogs", "programdata", "windows\\temp"]
SCRIPT_ENDINGS = [".bat", ".ps1", ".vbs", ".js", ".hta"]

# Names of logon types and of failure codes.
LOGON_TYPES = {2: "Interactive", 3: "Network", 4: "Batch", 5: "Service", 7: "Unlock", 8: "NetworkCleartext", 9: "NewCredentials", 10: "RemoteInteractive", 11: "CachedInteractive"}
FAILURES = {"0xc0000064": "User name does not exist", "0xc000006a": "Bad password", "0xc0000071": "Password expired", "0xc0000072": "Account disabled", "0xc0000193": "Account expired", "0xc0000234": "Account locked out"}


def named(code: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def brute_force(logons: DataFrame, threshold: int = 5, window_seconds: int | None = None, evidence: bool = True) -> DataFrame:
    """Users with at least threshold failures; CRITICAL if a success came at or after the first of them.

    Without window_seconds all failures of a user count together; with it, those of one tumbling window. record_ids lists the
    failures as evidence; without `evidence` it is left out, which spares a join.
    """
    user = F.lower("user")
    logons = logons.filter(F.col("user").isNotNull()).withColumn("user", user)
    keys = ["user"]
    if window_seconds:
        logons = logons.withColumn("window", F.window("ts", f"{window_seconds} seconds").start)
        keys.append("window")
    fail = ~F.col("success")
    out = logons.groupBy(*keys).agg(
        F.count_if(fail).alias("failures"), F.min(F.when(fail, F.col("ts"))).alias("first_failure"), F.max(F.when(fail, F.col("ts"))).alias("last_failure"),
        F.max(F.when(F.col("success"), F.col("ts"))).alias("_last_success"),
    )
    out = out.filter(F.col("failures") >= threshold)
    if evidence:  # ids of those above the threshold alone are gathered
        chosen = logons.filter(fail).join(out.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list("record_id")).alias("record_ids"))
        out = out.join(chosen, keys)
    out = out.withColumn("compromised", F.coalesce(F.col("_last_success") >= F.col("first_failure"), F.lit(False)))
    return out.withColumn("severity", F.when(F.col("compromised"), "CRITICAL").otherwise("HIGH")).drop("_last_success")


def password_spray(logons: DataFrame, threshold: int = 3, shown: int = 5) -> DataFrame:
    """Sources from which at least threshold distinct users failed; the first few names are shown."""
    failed = logons.filter(~F.col("success") & F.col("source_ip").isNotNull()).groupBy("source_ip", F.lower("user").alias("user")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    out = failed.groupBy("source_ip").agg(F.count("user").alias("users"), F.sum("n").alias("failures"), F.min("first").alias("first_failure"), F.max("last").alias("last_failure")).filter(F.col("users") >= threshold)
    first = F.row_number().over(Window.partitionBy("source_ip").orderBy("user"))
    names = failed.withColumn("_n", first).filter(F.col("_n") <= shown).groupBy("source_ip").agg(F.sort_array(F.collect_list("user")).alias("names"))
    return out.join(names, "source_ip", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("severity", F.lit("HIGH"))


def pass_the_hash(kind: Column, process: Column, package: Column, ip: Column, success: Column) -> Column:
    no_ip = ip.isNull() | ip.isin("", "-", "::1", "127.0.0.1")
    return success & (kind == 9) & (F.lower(process).contains("seclogo") | F.upper(package).contains("NTLM") | no_ip)


def cleartext_logon(kind: Column, success: Column) -> Column:
    return success & (kind == 8)


def command_reasons(command: Column) -> Column:
    """Why a service or task command is suspicious; an empty array if it isn't."""
    any_of = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    ends = lambda text: F.exists(F.array(*map(F.lit, SCRIPT_ENDINGS)), lambda w: F.endswith(F.trim(text), w))
    found = lambda text: F.array(F.when(any_of(text, EXEC_WORDS), "exec keyword"), F.when(any_of(text, WRITABLE_PATHS), "writable path"), F.when(ends(text), "script file"))
    return F.filter(let(F.lower(F.coalesce(command, F.lit(""))), found), lambda x: x.isNotNull())


def suspicious_commands(df: DataFrame, command: str) -> DataFrame:
    return computed(df, reasons=command_reasons(F.col(command))).filter(F.size("reasons") > 0).withColumn("severity", F.when(F.size("reasons") >= 2, "CRITICAL").otherwise("HIGH"))


def privileged_after_creation(created: DataFrame, granted: DataFrame) -> DataFrame:
    """granted (user, ...) with created_in_log, whether created (user, ...) has the account; names without case."""
    made = created.select(F.lower("user").alias("_user")).distinct().withColumn("_made", F.lit(True))
    out = granted.join(made, F.lower("user") == F.col("_user"), "left")
    return out.withColumn("created_in_log", F.coalesce("_made", F.lit(False))).drop("_user", "_made").withColumn("severity", F.when(F.col("created_in_log"), "CRITICAL").otherwise("HIGH"))
