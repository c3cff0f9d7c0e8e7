"""What is dear is computed once a row, whatever reads it."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from tracewright import streaming
from tracewright.functions import arrays
from tracewright.operators import auth_logs, files, processes, rules
from tracewright.plans import catalogue, evidence  # noqa: F401 (evidence adds to catalogue)
from tracewright.sources import logs, nested, packets


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_log_record_is_parsed_once(spark, tmp_path):
    """filters on fields of a record, and each field that a command is made of, had parsers of their own."""
    (tmp_path / "log.json").write_text('{"EventID":4698,"RecordId":1,"EventData":{"TaskName":"t","TaskContent":"<Exec><Command>mshta.exe</Command></Exec>"}}\n')
    events = logs.read_event_json(spark, f"file://{tmp_path}/log.json", lines=True)
    found = auth_logs.suspicious_commands(logs.service_events(events).filter("kind = 'task'"), "command").select("record_id", "command", "reasons")
    assert plan(found).lower().replace("_", "").count("parsejson") == 1, plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, "mshta.exe", ["exec keyword"])]


def test_computed_columns_stay_below_filters(spark):
    df = arrays.computed(spark.range(3).withColumn("t", F.col("id").cast("string")), n=F.regexp_replace("t", "x", "y"), m=F.lit(None).cast("int")).filter("n <> '1' and length(n) = 1")
    assert plan(df).count("regexp_replace(") == 1
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, "0", "0", None), (2, "2", "2", None)]


def test_approximate_users_never_exceed_failures(spark):
    """of sources with many users the approximate number was beyond the number of failures."""
    logons = spark.range(60).select(F.col("id").cast("string").alias("source_ip"), F.explode(F.sequence(F.lit(1).cast("long"), 40 * F.col("id") + 1)).alias("user"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(False).alias("success"))
    got = streaming.password_spray(logons.withColumn("user", F.col("user").cast("string")), 1, "1 day").collect()
    assert len(got) == 60 and all(r["users"] <= r["failures"] and r["users"] > 0.95 * r["failures"] for r in got)


def test_small_blocks_read_a_file_about_once(tmp_path, monkeypatch):
    """a block of any size read 4 MB of its file."""
    text = b"[" + b",".join(b'{"EventID": 4624, "RecordId": %d}' % i for i in range(30000)) + b"]"
    (tmp_path / "a.json").write_bytes(text)
    read = []

    class Counted:
        def __init__(self, file):
            self.file, self.seek, self.close = file, file.seek, file.close

        def read(self, n):
            read.append(n)
            return self.file.read(n)

    store = SimpleNamespace(open_input_file=lambda place: Counted(open(place, "rb")))
    monkeypatch.setattr(nested, "opened", lambda path: (store, path))
    starts = list(range(0, len(text), 1 << 12))
    ends = [min(s + (1 << 12), len(text)) for s in starts]
    n = len(starts)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in ([str(tmp_path / "a.json")] * n, [len(text)] * n, starts, ends)], names=["path", "bytes", "start", "end"])
    found = pa.Table.from_batches(list(nested._effects(iter([batch]))))
    assert found.num_rows == n and sum(read) < 2 * len(text)


SF = "/root/testdata/sf0.001"


def test_processes_without_a_pid_are_no_parents(spark):
    """all processes without a parent's pid were sorted as one key, and found those of unknown pid."""
    rows = [("h", "a", None, None, None, 1), ("h", "b", None, None, None, 2), ("h", "c", 7, None, None, 3), ("h", "d", 8, None, 7, 4), ("h", "e", None, "a", 7, 5), ("h", "f", None, "none", 7, 6)]
    p = spark.createDataFrame(rows, "host string, guid string, pid long, parent_guid string, parent_pid long, n long").withColumn("ts", F.timestamp_seconds("n"))
    assert {r["guid"]: r["parent"] for r in processes.parents(p).collect()} == {"a": None, "b": None, "c": None, "d": "c", "e": "a", "f": "c"}


def test_a_chunk_is_split_once_a_pattern(spark):
    """the places of a pattern's matches were computed up to four times a chunk."""
    chunks = spark.createDataFrame([(1, 0, "12345 ab 67890")], "doc_id long, chunk_off long, text string")
    found = rules.located(chunks, [("q", "any", "LOW", 1, ["[0-9]{5}"])], "text", ["doc_id"])
    assert plan(found).count("split(") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, "q", 0, 0, "12345"), (1, "q", 0, 9, "67890")]


def test_evidence_that_is_dear_is_dealt_over_tasks(spark):
    """F7, F8, F9: one task read a table of one row group and parsed all its messages."""
    n = 4 * spark.sparkContext.defaultParallelism
    for name in ("hidden_texts", "hidden_blobs", "hidden_reports", "dkim_signatures", "rule_offsets"):
        assert f", {n}" in plan(catalogue.QUERIES[name](spark, SF)).split("RepartitionByExpression [")[1].split("\n")[0], name


def test_a_signature_is_read_once(spark):
    """each tag that was looked up read the whole signature, once for each of its tags."""
    assert plan(catalogue.QUERIES["dkim_signatures"](spark, SF)).count("regexp_extract(") == 1


def test_strings_leave_a_task_in_small_batches():
    """all strings of a batch of pages were held at once, with the pages."""
    pages = [b"x" * 4000 + b"\x01" + b"a\x00" * 50 + b"\x01"] * 1000 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1001)]), pa.array([7] * 1001), pa.array(pages, pa.binary())], names=["image_id", "chunk_off", "bytes"])
    out = list(files._printable(iter([batch]), 6))
    assert max(b.nbytes for b in out) < 1 << 19
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert len(rows) == 2000 and set(rows[:2]) == {("0", 7, "ascii", "x" * 4000), ("0", 4008, "utf-16le", "a" * 50)}


def test_filters_on_packets_decode_no_headers(spark):
    """a filter on the transport decoded all headers of a frame again, and each header that was looked up read all of a request."""
    frames = spark.createDataFrame([("a", 1, 0, 60, 1, bytearray(60))], "path string, packet_num long, ts_micros long, wire_len long, link int, frame binary")
    p = packets.decoded(frames)
    assert plan(p.filter("transport in ('TCP', 'UDP')")).count("conv(") == plan(p).count("conv(")
    assert plan(packets.http_requests(p).select("host", "user_agent", "headers")).count("split(") == 1
