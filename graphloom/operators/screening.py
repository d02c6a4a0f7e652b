"""Screening of rows that peers send: nodes as JSON, shares, signed envelopes. The first rule that fails names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import uri_verdict

# What a remote node may hold, and how long its parts may be.
FILE_TYPES = ["code", "document", "paper", "image", "rationale"]
ALLOWED = [
    "id", "label", "file_type", "source_file", "room", "wing", "source_uri", "fetched_at", "embedding_id", "published", "tags", "summary", "title", "author", "authors", "chunk_index", "chunk_of", "language", "word_count",
    "content_hash", "oracle_kind", "asked_by", "status", "question_id", "answered_by", "confidence", "note_type",
]
MOST_NODE, MOST_LABEL, MOST_URI, MOST_STRING = 65_536, 8_192, 2_048, 1_024
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _failure(kind: str, field: str | Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (field if isinstance(field, Column) else F.lit(field)).alias("field"))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that later steps read as they are; without it Spark would work them out again wherever they are used."""
    return df.select(F.inline(F.array(F.struct(*df.columns, *[c.alias(n) for n, c in columns.items()]))))


def validate_remote_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(index, raw: JSON text) -> accepted(index, id, label, file_type, source_file, source_uri, fetched_at, extras) and rejected(index, kind, field).

    Rules in order: an object; at most MOST_NODE characters; id, label, source_file strings, short enough, without control
    characters (tab, line feed and return may stand); file_type; source_uri by uri_verdict(); fetched_at there and readable; other
    known strings, in the order in which they come. extras holds the other known fields that are no objects, as JSON; unknown fields are dropped.
    """
    v = _settled(rows.select("index", "raw"), text=F.to_json(F.try_parse_json("raw")), kind=F.schema_of_variant(F.try_parse_json("raw")))
    v = v.withColumn("is_object", F.coalesce(F.startswith("kind", F.lit("OBJECT")), F.lit(False))).withColumn("size", F.length("text")).drop("text", "kind")
    v = _settled(v, fields=F.when(F.col("is_object") & (F.col("size") <= MOST_NODE), F.from_json("raw", "map<string, variant>")))
    field = lambda f: F.element_at("fields", f)
    type_of = lambda x: F.schema_of_variant(x)
    string = lambda f: F.when(type_of(field(f)) == "STRING", F.try_variant_get(field(f), "$", "string"))
    names = ["id", "label", "source_file", "file_type", "source_uri", "fetched_at"]
    v = _settled(v, **{f: string(f) for f in names})
    v = _settled(v, verdict=uri_verdict(F.col("source_uri")))

    def plain(f: str, most: int) -> Column:
        c = F.col(f)
        return F.when(c.isNull(), _failure("InvalidFieldType", f)).when(F.length(c) > most, _failure("StringTooLong", f)).when(F.rlike(c, F.lit(CONTROL)), _failure("ControlCharacterInString", f))

    uri = F.col("verdict")
    at_uri = F.when(uri == "too_long", _failure("StringTooLong", "source_uri")).when(uri == "malformed", _failure("UriMalformed", "source_uri")).when(uri == "scheme", _failure("UriSchemeNotAllowed", "source_uri")).when(uri == "host", _failure("UriHostBlocked", "source_uri"))
    time = F.when(F.coalesce("fetched_at", F.lit("")) == "", _failure("FetchedAtMissing", "fetched_at")).when(F.try_to_timestamp("fetched_at").isNull(), _failure("FetchedAtInvalid", "fetched_at"))
    kind = F.when(F.col("file_type").isNull(), _failure("InvalidFieldType", "file_type")).when(~F.col("file_type").isin(FILE_TYPES), _failure("FileTypeNotAllowed", "file_type"))
    entries = F.filter(F.map_entries("fields"), lambda e: e["key"].isin([a for a in ALLOWED if a not in ("id", "label", "file_type", "source_file", "source_uri")]) & (type_of(e["value"]) == "STRING"))
    said = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
    bad = F.filter(said, lambda e: (F.length(e["value"]) > MOST_STRING) | F.rlike(e["value"], F.lit(CONTROL)))
    rest = F.when(F.size(bad) > 0, F.when(F.length(bad[0]["value"]) > MOST_STRING, _failure("StringTooLong", bad[0]["key"])).otherwise(_failure("ControlCharacterInString", bad[0]["key"])))
    root = F.when(~F.col("is_object"), _failure("InvalidFieldType", "<root>")).when(F.col("size") > MOST_NODE, _failure("SerialisedNodeTooLarge", "<root>"))
    checked = _settled(v, failure=F.coalesce(root, plain("id", MOST_URI), plain("label", MOST_LABEL), plain("source_file", MOST_URI), kind, at_uri, time, rest))
    flat = r"^(?:STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN|VOID|ARRAY<(?:STRING|BIGINT|DOUBLE|DECIMAL[^<>]*|BOOLEAN|VARIANT)>)$"
    extras = F.map_filter(F.transform_values("fields", lambda _, x: F.when(F.rlike(type_of(x), F.lit(flat)), F.to_json(x))), lambda k, x: k.isin([a for a in ALLOWED if a not in names]) & x.isNotNull())
    accepted = checked.filter("failure is null").select("index", "id", "label", "file_type", "source_file", "source_uri", "fetched_at", extras.alias("extras"))
    return accepted, checked.filter("failure is not null").select("index", "failure.kind", "failure.field")


def envelope_check(payload_id: Column, label: Column, optional: dict[str, Column], author: Column, github_user: Column, expected_author: Column | None = None, expected_user: Column | None = None) -> Column:
    """Why a signed payload is not taken, or null: id and label blank, an optional field that is no string (given as its schema's name), author or handle not as expected."""
    out = F.when(F.coalesce(payload_id, F.lit("")) == "", "invalid:id").when(F.coalesce(label, F.lit("")) == "", "invalid:label")
    for name, kind in optional.items():
        out = out.when(kind.isNotNull() & (kind != "STRING"), f"invalid:{name}")
    if expected_author is not None:
        out = out.when(expected_author.isNotNull() & ~author.eqNullSafe(expected_author), F.concat(F.lit("author_mismatch:"), expected_author, F.lit("!="), F.coalesce(author, F.lit("<missing>"))))
    if expected_user is not None:
        out = out.when(expected_user.isNotNull() & ~github_user.eqNullSafe(expected_user), F.concat(F.lit("github_mismatch:"), expected_user, F.lit("!="), F.coalesce(github_user, F.lit("<missing>"))))
    return out


def classify_shares(shares: DataFrame, mode: str = "soft") -> DataFrame:
    """shares(id, label, is_envelope, sig_valid, reason, ...) -> with verdict and why.

    A signed share is signed_ok where its signature is valid (sig_valid is given) and no reason of envelope_check() stands against it, else
    signed_invalid; an unsigned one with id and label is unsigned_allowed, in strict mode unsigned_rejected; all else is malformed.
    """
    if mode not in ("soft", "strict"):
        raise ValueError("mode is soft or strict")
    signed, shaped = F.coalesce("is_envelope", F.lit(False)), (F.coalesce("id", F.lit("")) != "") & F.col("label").isNotNull()
    ok = F.coalesce("sig_valid", F.lit(False)) & F.col("reason").isNull()
    verdict = F.when(signed & ok, "signed_ok").when(signed, "signed_invalid").when(shaped, "unsigned_rejected" if mode == "strict" else "unsigned_allowed").otherwise("malformed")
    why = F.when(verdict == "signed_invalid", F.coalesce("reason", F.lit("identity_error"))).when(verdict == "unsigned_rejected", "strict_mode_requires_signature").when(verdict == "malformed", "neither envelope nor shareable node")
    return shares.withColumn("verdict", verdict).withColumn("why", why)


def shareable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that say they are not private; a missing mark keeps a node back."""
    return nodes.filter(F.coalesce(F.col("private") == F.lit(False), F.lit(False)))


def filter_new_since(nodes: DataFrame, since: str | None) -> DataFrame:
    """Nodes fetched at that time or later; without a readable time all stay, else undated ones go."""
    at = F.try_to_timestamp(F.lit(since))
    return nodes.filter(at.isNull() | F.coalesce(F.try_to_timestamp(F.col("fetched_at").cast("string")) >= at, F.lit(False)))
