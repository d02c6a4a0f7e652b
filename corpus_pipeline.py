"""A corpus pipeline of five stages; each takes and gives back documents, the last gives token counts.

Defined results: null and empty texts and texts without words pass every stage but mixing, which takes
nothing of an empty text; repeated rows and null doc_ids are rows of their own, of which near_dedup keeps
one for each group of near copies; extra columns are dropped, whatever their names; without usable labels
no document is toxic; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, stored
from graphloom.llm.bpe import encode_documents
from graphloom.llm.minhash_dedup import near_duplicates
from graphloom.llm.mixing import WORD, mix_keyed
from graphloom.llm.secrets import redact
from graphloom.llm.toxicity import ToxicityModel

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under 0.5; the model learns from these documents and the labels."""
    d = pick(docs, *COLUMNS)
    model = ToxicityModel(d, read(spark, sf_dir, "labels"))
    return model.score(d, COLUMNS).filter("score < 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles: the smallest doc_id, null last.

    A text without words is in no group and stays.
    """
    d = pick(docs, *COLUMNS)
    rows = near_duplicates(d, width=5, keyed=True)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keys = rows.filter("component is not null").groupBy("component").agg(F.min(first).alias("k")).select(F.col("k.doc_id").alias("id_"), F.col("k.th").alias("key_"))
    keyed = d.withColumn("th_", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th_") == F.col("key_"))
    kept = keyed.join(keys, same, "left_semi").dropDuplicates(["doc_id", "th_"])
    wordless = d.filter(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0)
    return kept.select(*COLUMNS).unionByName(wordless)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return redact(pick(docs, *COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that is taken in part counts as taken."""
    d = pick(docs, *COLUMNS)
    copies = mix_keyed(d).filter("taken > 0").groupBy(F.col("doc_id").alias("id_"), "tie").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    keyed = d.withColumn("tie_", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tie_") == F.col("tie"))
    return keyed.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]
#: SQL cannot express the models, so there is none; tests/llm/test_pipeline.py holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written to the shared folder, read again, and deleted after the stage that reads it."""
    with Scratch(spark) as keep:
        docs = read(spark, sf_dir, "documents")
        for number, (_, stage) in enumerate(STAGES[:-1]):
            docs = keep.round(stage(spark, docs, sf_dir), number)
        return stored(STAGES[-1][1](spark, docs, sf_dir))
