"""Cloud audit records: flattening, mailbox and consent rules, impossible travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maps import first_of_each
from . import scans
from .alerts import rules

# Folders and words of hiding rules, scopes of broad consent, admin operations that reroute or raise.
HIDING_FOLDERS = ["rss", "archive", "junk", "deleted items", "conversation history", "notes", "trash"]
HIDING_WORDS = ["invoice", "payment", "wire", "bank", "password", "security", "hacked", "phish", "suspicious"]
RISKY_SCOPES = ["mail.read", "mail.readwrite", "mail.send", "mailboxsettings.readwrite", "files.readwrite.all", "directory.readwrite.all", "user.readwrite.all", "full_access_as_app", "offline_access"]
ADMIN_OPERATIONS = "(?i)(create_email_monitor|email_forwarding|change_mx|routing|delegate_admin|assign_role|grant_admin_privilege|super_admin)"


def flattened(audit: DataFrame, raw: str = "raw") -> DataFrame:
    """op, user, client_ip, ts_text, params from JSON records; keys of a nested AuditData string fill what the record lacks, its Parameters become a map."""
    outer, inner = F.col(raw), F.get_json_object(F.col(raw), "$.AuditData")
    field = lambda *names: F.coalesce(*(F.get_json_object(src, f"$.{n}") for n in names for src in (outer, inner)))
    pairs = F.from_json(field("Parameters"), "array<struct<Name:string,Value:string>>")
    return audit.withColumns({
        "op": field("Operation", "Operations"), "user": field("UserId", "UserIds", "actor.email"), "client_ip": F.regexp_extract(field("ClientIP", "ClientIPAddress", "ActorIpAddress", "ipAddress"), r"^\[?([0-9a-fA-F.:]+?)\]?(?::\d+)?$", 1),
        "ts_text": field("CreationTime", "CreationDate", "Date", "timestamp", "id.time"), "params": first_of_each(F.coalesce(pairs, F.array().cast("array<struct<Name:string,Value:string>>")), "Name"),
    })


def typed(records: DataFrame) -> DataFrame:
    """Flattened records with kind (inbox_rule, delegation, consent, login, other) and the fields that audit_rules reads."""
    op, p = F.lower("op"), lambda k: F.col("params")[k]
    kind = (
        F.when(op.isin("new-inboxrule", "set-inboxrule", "enable-inboxrule"), "inbox_rule").when(op.isin("add-mailboxpermission", "add-recipientpermission", "set-mailbox"), "delegation")
        .when(op.rlike("consent to application|authorize application|add app role assignment|add service principal"), "consent")
        .when(op.isin("userloggedin", "userloginfailed", "login", "login_verification", "login_failure"), "login").otherwise("other")
    )
    said = lambda k: F.coalesce(F.lower(p(k)) == "true", F.lit(False))
    return records.withColumns({
        "kind": kind, "forward_to": F.concat_ws(";", p("ForwardTo"), p("RedirectTo"), p("ForwardAsAttachmentTo")), "folder": p("MoveToFolder"), "delete_message": said("DeleteMessage"), "mark_read": said("MarkAsRead"),
        "keywords": F.concat_ws(";", p("SubjectContainsWords"), p("BodyContainsWords")), "access": p("AccessRights"), "trustee": F.coalesce(p("User"), p("Trustee")), "scopes": p("Scope"),
        "success": ~F.contains(op, F.lit("fail")),
    })


def external_forwards(records: DataFrame, keep: list[str]) -> DataFrame:
    """keep, target: addresses outside the user's domain that inbox rules forward to; all of them where none is outside."""
    all_ = addresses(F.col("forward_to"))
    outside = external(all_, F.substring_index("user", "@", -1))
    return records.filter(F.lower("op").isin("new-inboxrule", "set-inboxrule", "enable-inboxrule")).select(*keep, F.explode(F.when(F.size(outside) > 0, outside).otherwise(all_)).alias("target"))


def addresses(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[;,|\s]+"), lambda x: F.contains(x, F.lit("@")))


def external(list_: Column, domain: Column) -> Column:
    """Addresses outside the domain; the whole part after @ must equal it."""
    return F.filter(list_, lambda a: F.substring_index(a, "@", -1) != F.lower(domain))


def any_in(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))


def audit_rules(records: DataFrame, keep: list[str]) -> DataFrame:
    """Rules over records (op, user, forward_to, folder, delete_message, mark_read, keywords, access, trustee, scopes)."""
    domain = F.substring_index("user", "@", -1)
    inbox = F.col("op").isin("New-InboxRule", "Set-InboxRule")
    hides = any_in(F.col("folder"), HIDING_FOLDERS) | F.col("delete_message") | (F.col("mark_read") & any_in(F.col("keywords"), HIDING_WORDS))
    outsider = F.size(external(addresses(F.col("trustee")), domain)) > 0
    table = [
        ("EXTERNAL_FORWARDING", "CRITICAL", "T1114.003", inbox & (F.size(addresses(F.col("forward_to"))) > 0)),
        ("EMAIL_HIDING_RULE", "HIGH", "T1564.008", inbox & hides),
        ("UNAUTHORIZED_MAILBOX_DELEGATION", "HIGH", "T1098.002", (F.col("op") == "Add-MailboxPermission") & (F.col("access").isin("FullAccess", "SendAs", "SendOnBehalf") | outsider)),
        ("HIGH_RISK_OAUTH_CONSENT", "HIGH", "T1528", F.col("op").startswith("Consent to application") & any_in(F.col("scopes"), RISKY_SCOPES)),
        ("SUSPICIOUS_ADMIN_ACTIVITY", "HIGH", "T1098", F.col("op").rlike(ADMIN_OPERATIONS)),
    ]
    return rules(records, table, keep)


def impossible_travel(logins: DataFrame, seconds: int = 3600, tie: str = "record_id") -> DataFrame:
    """Successive logins (user, ts, country) of one user from two countries within so many seconds."""
    out = scans.led(logins.filter("ts is not null"), ["user"], ["ts", tie], F.struct("ts", "country", F.col(tie).alias("id")), "_next")
    out = out.withColumns({"next_ts": F.col("_next.ts"), "next_country": F.col("_next.country"), "next_record_id": F.col("_next.id")}).drop("_next")
    gap = (F.unix_micros("next_ts") - F.unix_micros("ts")) / 1000000
    return out.withColumn("seconds", gap).filter((F.col("country") != F.col("next_country")) & F.col("seconds").between(0, seconds))


def admin_events(activities: DataFrame) -> DataFrame:
    """One row per element of events (array of struct<name, parameters array<struct<name,value>>>), parameters as a map."""
    one = activities.withColumn("event", F.explode_outer("events"))
    pairs = first_of_each(F.transform("event.parameters", lambda p: F.struct(p["name"].alias("k"), p["value"].alias("v"))))
    return one.withColumns({"op": F.col("event.name"), "params": pairs}).drop("events", "event")
