"""JSON arrays and envelopes cut into blocks anywhere, against Python's own parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewright.sources import logs, nested


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice('ab"\\{}[]:,é😀\n ') for _ in range(rng.randrange(12)))
    if kind < 4:
        return rng.choice([1, -2.5, True, None, "\\", '\\"', ""])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "Events", "b]", 'c"']): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_records_of_any_block_size(spark, tmp_path, block):
    rng = random.Random(block)
    objects = [{"id": i, "v": value(rng)} for i in range(25 if block < 8 else 300)]
    mixed = [o for o in objects[:9]] + [1, "x]", None, [1, {"y": [2]}]]
    dump = lambda x: json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
    made = {
        "list": (dump(objects), objects), "events": (dump({"Meta": [{"no": 1}], "m": {"Events": [{"no": 2}]}, "Events": objects, "After": [{"no": 3}], "s": "Events"}), objects), "lines": ("\n".join(json.dumps(o) for o in objects), objects),
        "one": (dump(objects[0]), objects[:1]), "mixed": ("\ufeff " + json.dumps(mixed), [x for x in mixed if isinstance(x, (dict, list))]), "empty": ("[]", []), "none": ('{"Events": []}', []),
    }
    for name, (text, _) in made.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    (tmp_path / "void.json").write_text("")
    got = {}
    for r in nested.read_records(spark, f"file://{tmp_path}/*.json", ("Events",), block).select(F.regexp_extract("path", r"(\w+)\.json$", 1).alias("name"), "at", "raw").collect():
        got.setdefault(r["name"], []).append((r["at"], json.loads(r["raw"])))
    for name, (_, want) in made.items():
        assert [v for _, v in sorted(got.get(name, []), key=lambda x: x[0])] == want, name


def test_events_and_rejects_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"EventID": 1, "RecordId": 5}, {"EventID": 1, "EventID": 2}, [3], {"EventID": 4,')
    events, rejects = logs.read_event_files(spark, f"file://{tmp_path}", 10)
    assert [(r["event_id"], r["record_id"]) for r in events.collect()] == [(1, 5)]
    assert {r["raw"]: r["reason"] for r in rejects.collect()} == {'{"EventID": 1, "EventID": 2}': "REPEATED_KEY", "[3]": "NOT_AN_OBJECT", '{"EventID": 4,': "NOT_JSON"}
    (tmp_path / "b.json").write_text('{"value": [{"Id": 1}, {"Id": 2}], "next": "x"}')
    assert sorted(r["raw"] for r in logs.read_audit_files(spark, f"file://{tmp_path}/b.json", 8).collect()) == ['{"Id": 1}', '{"Id": 2}']
