"""Records that are odd in one place cost no more than themselves."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import domains, maps, text
from tracewright.operators import cloud, hidden, iocs, messages, posture, rules
from tracewright.sources import logs, packets, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_repeated_keys(spark):
    assert one(spark, messages.dkim_tags(F.lit("v=1; d=a.com; D = b.com; s; =x; p=q=r"))) == {"v": "1", "d": "a.com", "": "x", "p": "q=r"}
    assert one(spark, posture.dkim_key(F.lit("v=DKIM1; p=abc; p=def; k=rsa; k=x"))["key_type"]) == "rsa"
    assert one(spark, posture.dmarc(F.array(F.lit("v=DMARC1; p=reject; p=none")))["policy"]) == "reject"
    assert one(spark, maps.text_map(F.lit("MD5=a,MD5=b,SHA1,SHA256=c=d"), ",", "=")) == {"MD5": "a", "SHA1": None, "SHA256": "c=d"}
    raw = json.dumps({"Operation": "New-InboxRule", "Parameters": [{"Name": "To", "Value": "a"}, {"Name": "To", "Value": "b"}, {"Name": None, "Value": "c"}]})
    assert cloud.flattened(spark.createDataFrame([(raw,)], "raw string")).first()["params"] == {"To": "a"}
    admin = spark.createDataFrame([([("e", [("p", "1"), ("p", "2")])],)], "events array<struct<name:string,parameters:array<struct<name:string,value:string>>>>")
    assert cloud.admin_events(admin).first()["params"] == {"p": "1"}


def test_names_that_are_no_names(spark):
    names = ["é" * 80 + ".example", "bücher.example", "a..é", "plain.example"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["a"] for r in df.select(domains.ascii_name(F.col("n")).alias("a")).collect()] == [None, "xn--bcher-kva.example", None, "plain.example"]
    assert df.select(*(c.alias(k) for k, c in domains.targets(F.col("n")).items())).count() == 4


LINES = ['{"EventID": 4624, "RecordId": 7, "EventData": {"TargetUserName": "u", "LogonType": 3}, "Extra": {"a": [1]}}', '{"EventID": 1, "EventID": 2}', '{"EventID": 1, "EventData": {"x": 1, "x": 2}}', '{"EventID":', "[1, 2]", "null", '{"EventID": "four", "RecordId": {"a": 1}}', "  "]


def test_events_and_rejects(spark, tmp_path):
    (tmp_path / "log.json").write_text("\n".join(LINES))
    path = f"file://{tmp_path}/log.json"
    got = {r["record_id"]: (r["event_id"], r["data"]) for r in logs.read_event_json(spark, path, lines=True).collect()}
    assert got == {7: (4624, {"TargetUserName": "u", "LogonType": "3", "EventID": "4624", "RecordId": "7", "Extra": '{"a":[1]}'}), None: (None, {"EventID": "four", "RecordId": '{"a":1}'})}
    rejected = logs.rejected_events(spark, path, lines=True)
    assert {r["raw"]: r["reason"] for r in rejected.collect()} == {LINES[1]: "REPEATED_KEY", LINES[2]: "REPEATED_KEY", LINES[3]: "NOT_JSON", LINES[4]: "NOT_AN_OBJECT", LINES[5]: "NOT_AN_OBJECT"}
    assert {r["reason"]: r["records"] for r in records.rejects_by_reason(rejected).collect()} == {"REPEATED_KEY": 2, "NOT_JSON": 1, "NOT_AN_OBJECT": 2}
    (tmp_path / "list.json").write_text("[" + ",".join(LINES[:3]) + "]")
    assert {r["record_id"] for r in logs.read_event_json(spark, f"file://{tmp_path}/list.json").collect()} == {7}


@pytest.mark.parametrize(
    "payload,want",
    [
        ("USER a\r\nUSER b\r\nPASS longpb\r\n", [("b", "******")]),
        ("USER a\r\nPASS p1\r\nPASS p2secret\r\n", [("a", "**"), ("a", "p2****et")]),
        ("PASS nobody1\r\nUSER a\r\nPASS secret1\r\n", [(None, "no***y1"), ("a", "se***t1")]),
        ("login: a\r\nPassword: b\r\nlogin: c\r\npassword: d\r\n", [("a", "*"), ("c", "*")]),
        ("user\r\n", []),
    ],
)
def test_passwords_belong_to_the_user_before(spark, payload, want):
    df = spark.createDataFrame([(1, payload)], "id int, payload string")
    got = packets.cleartext_credentials(df, "payload", ["id"]).collect()
    assert [(r["username"], r["secret"]) for r in got] == want


def test_context_of_neighbours(spark):
    df = spark.createDataFrame([("10.0.0.1 then\r\n10.0.0.2 " + "x" * 60,)], "text string")
    got = [(r["value"], r["context"]) for r in iocs.with_context(df, "text", iocs.PATTERNS["ipv4"]).collect()]
    assert got == [("10.0.0.1", "10.0.0.1 then  10.0.0.2 " + "x" * 24), ("10.0.0.2", "10.0.0.1 then  10.0.0.2 " + "x" * 39)]


def test_indicators_of_all_forms(spark):
    df = spark.createDataFrame([("see 2001:db8::1 and 1:2:3:4:5:6:7:8, -----Begin ec private key----- here",)], "text string")
    assert {(r["ioc_type"], r["value"]) for r in iocs.extract(df, "text", [], ["ipv6", "private_key"]).collect()} == {("ipv6", "2001:db8::1"), ("ipv6", "1:2:3:4:5:6:7:8"), ("private_key", "-----Begin ec private key-----")}


def test_wide_commands(spark):
    rows = ["Get-Item", "Получить 项目 😀", "  blank ", ""]
    encoded = [base64.b64encode(r.encode("utf-16le")).decode() for r in rows] + [base64.b64encode(b).decode() for b in (b"a\x00\x00\xd8b\x00", b"\x3d\xd8", b"a\x00b", b"\x00\xde\x3d\xd8\x00\xde")] + ["%%"]
    got = [r["x"] for r in spark.createDataFrame([(e,) for e in encoded], "e string").select(text.decoded_wide(F.col("e")).alias("x")).collect()]
    assert got == ["Get-Item", "Получить 项目 😀", "blank", "", "a�b", "�", "a�", "�😀", None]


def test_matches_in_chunks_are_those_of_the_whole_text(spark):
    import random
    import re

    rng = random.Random(9)
    patterns = ["[0-9]{5}", "ab+", "(?i)x[a-c]{1,9}", "[a-c]{3}", r"\bab"]
    rows = [(i, "".join(rng.choice("abc0123456789 xX") for _ in range(n))) for i, n in enumerate((0, 5, 99, 100, 101, 700, 3000))] + [(7, "x" * 934 + "0123456789" + "y" * 200)]
    want = {(i, n, m.start(), m[0]) for i, t in rows for n, p in enumerate(patterns) for m in re.finditer(p, t)}
    size, overlap = 100, 40
    chunks = [(i, off, t[off : off + size]) for i, t in rows for off in range(0, max(1, len(t) - overlap), size - overlap)]
    rule = [("r", "any", "LOW", 1, patterns)]
    got = rules.located(spark.createDataFrame(chunks, "id int, chunk_off long, text string"), rule, "text", ["id"], overlap).collect()
    assert len(got) == len(want) and {(r["id"], r["pattern"], r["offset"], r["value"]) for r in got} == want
    whole = rules.located(spark.createDataFrame(rows, "id int, text string"), rule, "text", ["id"]).collect()
    assert len(whole) == len(want) and {(r["id"], r["pattern"], r["offset"], r["value"]) for r in whole} == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div hidden>a<p>b</div>c", [("HIDDEN_ATTRIBUTE", "div", "ab")]),
        ('<p style="display:none">a<p>b</p>c', [("CSS_DISPLAY_NONE", "p", "abc")]),  # the end tag closes the inner one
        ('<b><i style="visibility: hidden">a</b>b</i>c', [("CSS_VISIBILITY_HIDDEN", "i", "a")]),
        ('<span style="opacity:0"></span><img hidden><br style="display:none">x', []),
        ('<p STYLE="Font-Size: 0px">t</p><p style="font-size:0.5em">n</p>', [("CSS_ZERO_FONT_SIZE", "p", "t"), ("CSS_ZERO_FONT_SIZE", "p", "n")]),
        ('<p style="color:rgba(1,2,3,0)">t</p><p style="color:#000;background:black">u</p><p style="color:red;background:red">v</p>', [("CSS_TRANSPARENT_COLOR", "p", "t"), ("CSS_SAME_COLOR_BG", "p", "u"), ("CSS_SAME_COLOR_BG", "p", "v")]),
        ('<p style="text-indent:-9999px">t</p><p style="max-height:0; overflow:hidden">u</p><p style="left:-10px">v</p>', [("CSS_OFF_SCREEN_POSITION", "p", "t"), ("CSS_ZERO_HEIGHT_OVERFLOW", "p", "u")]),
        ("<!-- short --><!--[if mso]> conditional comment <![endif]--><!-- a long enough comment -->", [("HTML_COMMENT", "comment", "a long enough comment")]),
        ('<div hidden style="display:none">a &amp; <script>no</script>b', [("HIDDEN_ATTRIBUTE", "div", "a &b"), ("CSS_DISPLAY_NONE", "div", "a &b")]),
        ("<div hidden>never closed", [("HIDDEN_ATTRIBUTE", "div", "never closed")]),
        ("</div><p hidden=''>t", [("HIDDEN_ATTRIBUTE", "p", "t")]),
    ],
)
def test_hidden_elements(html, want):
    assert hidden.elements(html, 15) == want


def test_blobs_of_both_parts_mostly_printable(spark):
    plain = base64.b64encode(b"plain words of a message\x01\x02").decode()
    noise = base64.b64encode(bytes(range(128, 190))).decode()
    df = spark.createDataFrame([(1, f'<a href="data:text/html;base64,{plain}">', f"{plain} {noise} AAAA"), (2, "&#x43a;&#1103;&#x1F600;&#X41;", r"\x41\x42\xff\x43\x44 %D0%BA%20a%41"), (3, None, None)], "k long, html string, text string")
    got = {(r["k"], r["kind"], r["decoded"]) for r in hidden.blobs(hidden.content(df, "k", "html", "text")).collect()}
    assert got == {(1, "BASE64_TEXT", "plain words of a message\x01\x02"), (2, "HTML_ENTITIES", "кя😀A"), (2, "HEX_ESCAPES", "ABCD"), (2, "PERCENT_ESCAPES", "к aA")}


def test_complete_mode_after_a_restart(spark, tmp_path):
    from tracewright import streaming

    source = f"{tmp_path}/in"
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").write.parquet(source)
    run = lambda: {r["k"]: r["count"] for r in streaming.drained(spark.readStream.schema("k string").parquet(source).groupBy("k").count(), "complete", f"{tmp_path}/check", f"{tmp_path}/out").collect()}
    assert run() == {"a": 2, "b": 1} and run() == {"a": 2, "b": 1}
    spark.createDataFrame([("a",)], "k string").write.mode("append").parquet(source)
    assert run() == {"a": 3, "b": 1}
