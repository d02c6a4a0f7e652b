import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import screening

GOOD = {"id": "n1", "label": "L", "file_type": "code", "source_file": "a.ts", "fetched_at": "2024-01-01T00:00:00Z"}


def test_first_failing_rule(spark):
    rows = [
        (GOOD, None), ([1], "InvalidFieldType <root>"), (GOOD | {"id": 5}, "InvalidFieldType id"), ({k: v for k, v in GOOD.items() if k != "label"}, "InvalidFieldType label"), (GOOD | {"label": "x" * 8193}, "StringTooLong label"),
        (GOOD | {"label": "x" * 8192}, None), (GOOD | {"label": "a\x01"}, "ControlCharacterInString label"), (GOOD | {"label": "a\tb\nc\rd"}, None), (GOOD | {"id": "x" * 2049, "file_type": "exe"}, "StringTooLong id"), (GOOD | {"file_type": "exe", "source_uri": "ftp://x"}, "FileTypeNotAllowed file_type"),
        (GOOD | {"file_type": 3}, "InvalidFieldType file_type"), (GOOD | {"source_uri": "ftp://x"}, "UriSchemeNotAllowed source_uri"), (GOOD | {"source_uri": "http://127.0.0.1/", "fetched_at": ""}, "UriHostBlocked source_uri"), (GOOD | {"source_uri": 7}, None),
        (GOOD | {"fetched_at": ""}, "FetchedAtMissing fetched_at"), (GOOD | {"fetched_at": "never"}, "FetchedAtInvalid fetched_at"), (GOOD | {"title": "t" * 1025}, "StringTooLong title"), (GOOD | {"summary": "\x02", "title": "t" * 1025}, "ControlCharacterInString summary"),
        (GOOD | {"unknown": "t" * 5000}, None), (GOOD | {"unknown": "t" * 70_000}, "SerialisedNodeTooLarge <root>"),
    ]
    raw = [json.dumps(r) for r, _ in rows] + ["not json", None, "{}", '"text"']
    want = [w for _, w in rows] + ["InvalidFieldType <root>", "InvalidFieldType <root>", "InvalidFieldType id", "InvalidFieldType <root>"]
    ok, no = screening.validate_remote_nodes(spark.createDataFrame(list(enumerate(raw)), "index long, raw string"))
    assert {r["index"]: f"{r.kind} {r.field}" for r in no.collect()} == {i: w for i, w in enumerate(want) if w}
    assert {r["index"] for r in ok.collect()} == {i for i, w in enumerate(want) if not w}


def test_only_known_plain_fields_pass(spark):
    node = GOOD | {"tags": ["a", "b"], "__proto__": {"x": 1}, "evil": "y", "confidence": 0.5, "author": {"x": 1}, "authors": [{"x": 1}], "summary": "ok", "word_count": 3, "note_type": None, "status": True}
    ok, _ = screening.validate_remote_nodes(spark.createDataFrame([(0, json.dumps(node))], "index long, raw string"))
    r = ok.first()
    assert {k: json.loads(v) for k, v in r.extras.items()} == {"tags": ["a", "b"], "confidence": 0.5, "summary": "ok", "word_count": 3, "note_type": None, "status": True}
    assert (r.id, r.source_uri, r.fetched_at) == ("n1", None, "2024-01-01T00:00:00Z")


def test_shares_by_mode(spark):
    s = spark.createDataFrame([("a", "l", True, True, None), ("a", "l", True, False, None), ("a", "l", True, True, "invalid:id"), ("a", "l", False, None, None), ("", "l", False, None, None), (None, None, None, None, None)], "id string, label string, is_envelope boolean, sig_valid boolean, reason string")
    of = lambda mode: [r.verdict for r in screening.classify_shares(s, mode).collect()]
    assert of("soft") == ["signed_ok", "signed_invalid", "signed_invalid", "unsigned_allowed", "malformed", "malformed"]
    assert of("strict")[3] == "unsigned_rejected"
    with pytest.raises(ValueError):
        screening.classify_shares(s, "off")
    x = spark.range(1).select(
        screening.envelope_check(F.lit("i"), F.lit("l"), {"summary": F.lit("BIGINT")}, F.lit("a"), F.lit(None)).alias("kind"), screening.envelope_check(F.lit("i"), F.lit("l"), {}, F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit("me")).alias("user"),
        screening.envelope_check(F.lit("i"), F.lit("l"), {}, F.lit("a"), F.lit("me"), F.lit("a"), F.lit("me")).alias("ok"),
    ).first()
    assert (x.kind, x.user, x.ok) == ("invalid:summary", "github_mismatch:me!=<missing>", None)
    n = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2023-01-01")], "id long, fetched_at string")
    assert [r.id for r in screening.filter_new_since(n, "2024-01-01").collect()] == [1] and screening.filter_new_since(n, "when").count() == 3 == screening.filter_new_since(n, None).count()
