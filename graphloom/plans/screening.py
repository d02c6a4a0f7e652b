"""Queries on rows that peers send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog import query
from graphloom.frames import read
from graphloom.operators import screening

#: Every document as a peer's JSON; two of three carry a defect that their number says.
DEFECTS = {
    1: ("InvalidFieldType", "<root>"), 2: ("InvalidFieldType", "id"), 3: ("StringTooLong", "label"), 4: ("ControlCharacterInString", "label"), 5: ("InvalidFieldType", "source_file"), 6: ("FileTypeNotAllowed", "file_type"),
    7: ("UriSchemeNotAllowed", "source_uri"), 8: ("UriHostBlocked", "source_uri"), 9: ("FetchedAtMissing", "fetched_at"), 10: ("FetchedAtInvalid", "fetched_at"), 11: ("StringTooLong", "title"), 12: ("SerialisedNodeTooLarge", "<root>"),
}


def sent(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    k = i % 18
    docs = read(spark, d, "documents")
    label = F.when(k == 3, F.repeat(F.lit("x"), 9000)).when(k == 4, F.concat(F.lit("a"), F.lit("\x01"))).otherwise(F.concat(F.lit("doc "), i.cast("string"), F.lit("\ttab")))
    uri = F.when(k == 7, "ftp://example.com/").when(k == 8, "http://10.0.0.1/").when(i % 2 == 0, F.concat(F.lit("https://example.com/"), i.cast("string")))
    at = F.when(k == 10, "some day").when(k != 9, "2024-01-05T00:00:00Z")
    fields = [F.when(k != 5, F.col("source")).alias("source_file"), F.when(k == 6, "exe").otherwise("document").alias("file_type"), label.alias("label"), uri.alias("source_uri"), at.alias("fetched_at"), F.when(k == 11, F.repeat(F.lit("t"), 1025)).otherwise(F.col("lang")).alias("title"), F.col("n_chars").alias("word_count"), F.lit(1).alias("__proto__"), F.when(k == 12, F.repeat(F.lit("z"), 70_000)).alias("junk")]
    plain = F.to_json(F.struct(F.concat(F.lit("n"), i.cast("string")).alias("id"), *fields))
    return docs.select(i.alias("index"), F.when(k == 1, F.concat(F.lit("["), plain, F.lit("]"))).when(k == 2, F.to_json(F.struct(i.alias("id"), *fields))).otherwise(plain).alias("raw"))


CASES = " ".join(f"WHEN {k} THEN '{kind} {field}'" for k, (kind, field) in DEFECTS.items())


@query("validate_remote_nodes", f"""
WITH x AS (SELECT *, CASE doc_id % 18 {CASES} END AS failure FROM documents)
SELECT doc_id AS index, coalesce(failure, 'accepted') AS outcome, CASE WHEN failure IS NULL THEN 'n' || doc_id END AS id, CASE WHEN failure IS NULL THEN 'doc ' || doc_id || chr(9) || 'tab' END AS label, CASE WHEN failure IS NULL AND doc_id % 2 = 0 THEN 'https://example.com/' || doc_id END AS source_uri,
  CASE WHEN failure IS NULL THEN 'title="' || lang || '" word_count=' || n_chars END AS extras FROM x""")
def validated(spark: SparkSession, d: str) -> DataFrame:
    ok, no = screening.validate_remote_nodes(sent(spark, d))
    extras = F.array_join(F.transform(F.array_sort(F.map_entries("extras")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    a = ok.select("index", F.lit("accepted").alias("outcome"), "id", "label", "source_uri", extras.alias("extras"))
    return a.unionByName(no.select("index", F.concat_ws(" ", "kind", "field").alias("outcome")), allowMissingColumns=True)


@query("classify_shares", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN 'n' || event_id ELSE '' END AS id, CASE WHEN event_id % 7 > 0 THEN event_type END AS label, event_id % 2 = 0 AS signed, event_id % 6 = 0 AS valid, 'did:' || event_id % 3 AS author, CASE WHEN event_id % 4 > 0 THEN 'did:' || event_id % 3 ELSE 'did:x' END AS wanted FROM events),
r AS (SELECT *, CASE WHEN id = '' THEN 'invalid:id' WHEN coalesce(label, '') = '' THEN 'invalid:label' WHEN author <> wanted THEN 'author_mismatch:' || wanted || '!=' || author END AS reason FROM s),
v AS (SELECT *, CASE WHEN signed AND valid AND reason IS NULL THEN 'signed_ok' WHEN signed THEN 'signed_invalid' WHEN id <> '' AND label IS NOT NULL THEN 'unsigned_rejected' ELSE 'malformed' END AS verdict FROM r)
SELECT event_id, verdict, CASE verdict WHEN 'signed_invalid' THEN coalesce(reason, 'identity_error') WHEN 'unsigned_rejected' THEN 'strict_mode_requires_signature' WHEN 'malformed' THEN 'neither envelope nor shareable node' END AS why FROM v""")
def shares(spark: SparkSession, d: str) -> DataFrame:
    """Strict mode; every fourth share is not by the author that is expected."""
    i = F.col("event_id")
    author = F.concat(F.lit("did:"), (i % 3).cast("string"))
    ident, label = F.when(i % 11 > 0, F.concat(F.lit("n"), i.cast("string"))).otherwise(""), F.when(i % 7 > 0, F.col("event_type"))
    reason = screening.envelope_check(ident, label, {}, author, F.lit(None).cast("string"), F.when(i % 4 > 0, author).otherwise("did:x"))
    s = read(spark, d, "events").select("event_id", ident.alias("id"), label.alias("label"), (i % 2 == 0).alias("is_envelope"), (i % 6 == 0).alias("sig_valid"), reason.alias("reason"))
    return screening.classify_shares(s, "strict").select("event_id", "verdict", "why")


@query("shareable_nodes", "SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def shareable(spark: SparkSession, d: str) -> DataFrame:
    """A third is private, a third does not say."""
    i = F.col("doc_id")
    return screening.shareable_nodes(read(spark, d, "documents").withColumn("private", F.when(i % 3 == 0, True).when(i % 3 == 1, False))).select("doc_id")


@query("filter_new_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' AND event_id % 13 > 0")
def new_since(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("fetched_at", F.when(F.col("event_id") % 13 > 0, F.col("ts")))
    return screening.filter_new_since(e, "2024-01-11 00:00:00").select("event_id")
