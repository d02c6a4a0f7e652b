"""Secret scans with a random forest for false positives (operator 8).

Candidates are the values assigned to a name such as token, secret, password or key, from SHORTEST
characters on over any non-space characters, private key blocks and signed web tokens, and elsewhere runs of 16 or more letters, digits and +/=_-,
in whole texts. A forest judges each by its
length, its character classes and transitions, its entropy, how much of it dictionary words cover,
its path (the source) and its neighbouring words, these hashed to HASHED places each. It is trained on labelled findings, at most about
FINDINGS of them: equal ones are taken once with their number as weight, and a hash chooses in each
label on its own, the rare one being taken whole where it has no more than half of FINDINGS. The query labels findings by how they stand: a hexadecimal
value or one with digits that is assigned to such a name is a finding that was confirmed, a candidate
that is not assigned one that was rejected, and other assigned values have no label; the forest then
judges all without the assignment sign, from the features alone. The dictionary is every word in at least one of DICTIONARY documents; so a
document's mean number of different words times DICTIONARY bounds it.

Defined results: null and empty texts have no candidates; doc_ids pass through, null or repeated;
without confirmed findings no candidate is a secret and every score is 0; with confirmed findings alone
every candidate is one with score 1; an empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import Scratch, pick, read, scratched

FINDINGS, DICTIONARY, HASHED, SHORTEST = 20_000, 500, 16, 6
_RUN = re.compile(r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/_\-][A-Za-z0-9+/=_\-]{15,}")
#: A value in quotes ends before the quote; the marks that end a bare one's sentence are not its own.
_NAMED = re.compile(
    r"(?:token|secret(?:[_-]?key)?|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth)[\"']?\s*(?::=|=>|=|:)\s*"
    rf"(?:\"(?P<double>[^\s\"]{{{SHORTEST},}})\"|'(?P<single>[^\s']{{{SHORTEST},}})'|(?P<bare>\S{{{SHORTEST - 1},}}[^\s.,;:\"']))", re.IGNORECASE,
)
#: Formats that are secrets of their own: signed web tokens, and private key blocks, whose marks are found on their own.
_SIGNED = re.compile(r"(?<![\w.-])eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}")
_BEGIN, _END = (re.compile(rf"-----{mark} [A-Z ]{{0,32}}PRIVATE KEY-----") for mark in ("BEGIN", "END"))
#: Characters between the marks of a key block, at least.
LEAST_KEY = 16
_NEAR = re.compile(r"[^\W_]+")
_LOWER = re.compile(r"[a-z]{3,}")


def dictionary(docs: DataFrame) -> list[str]:
    """Words of 3 to 12 letters in at least one of DICTIONARY documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for t in b.slice(at, 256).column(0).to_pylist():
                    seen.update({w for w in _LOWER.findall(t.lower()) if len(w) <= 12} if t else ())
                if len(seen) > 200_000:
                    yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    least = max(2, docs.count() // DICTIONARY)
    words = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return sorted(words.select("word").toArrow()["word"].to_pylist())


def _shape(s: str) -> list[float]:
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in s]
    n = len(s)
    share = [kinds.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    is_hex = float(all(c in "0123456789abcdefABCDEF" for c in s))
    return [float(n), *share, moves, entropy, is_hex]


def _covered(s: str, words: set[str]) -> float:
    """Share of the characters that dictionary words cover, longest word first from the left."""
    low, at, hit = s.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), 2, -1):
            if low[at : at + size] in words:
                hit += size
                at += size
                break
        else:
            at += 1
    return hit / len(s)


def _slot(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % HASHED


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private key blocks of any length: each first mark with the next end mark that leaves room for a key; none overlap."""
    out, done, ends = [], 0, [m.span() for m in _END.finditer(text)]
    starts = [e[0] for e in ends]
    for m in _BEGIN.finditer(text):
        k = bisect.bisect_left(starts, m.end() + LEAST_KEY)
        if m.start() >= done and k < len(ends):
            done = ends[k][1]
            out.append((m.start(), done))
    return out


def spans(text: str) -> list[tuple[int, int, bool]]:
    """Start, end, whether assigned to a secret name, of the candidates of a text; none overlap."""
    out, names = [], []
    for m in _NAMED.finditer(text):
        start, end = m.span(m.lastgroup)
        out.append((start, end, True))
        names.append((m.start(), end))
    blocks = key_blocks(text)
    if blocks:  # a block is one candidate, whatever stands inside it; one that begins inside an assigned value is that value's
        inside = lambda at: (k := bisect.bisect(blocks, (at, len(text) + 1))) > 0 and blocks[k - 1][1] > at
        held = [n for n in names if not inside(n[0])]
        blocks = [b for b in blocks if (k := bisect.bisect(held, b)) == 0 or held[k - 1][1] <= b[0]]
        gone = {n[1] for n in names} - {n[1] for n in held}
        out = [c for c in out if c[1] not in gone] + [(*b, True) for b in blocks]
        names = sorted([*held, *blocks])
    for m in _SIGNED.finditer(text):
        k = bisect.bisect(names, m.span())
        if (k == 0 or names[k - 1][1] <= m.start()) and (k == len(names) or names[k][0] >= m.end()):
            out.append((*m.span(), True))
            names.insert(k, m.span())
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(names) and names[at][1] <= start:
            at += 1
        # what stands before a name or after a value is a candidate of its own
        pieces, k = [], at
        while k < len(names) and names[k][0] < end:
            pieces.append((start, names[k][0]))
            start = max(start, names[k][1])
            k += 1
        out.extend((a, b, False) for a, b in [*pieces, (start, end)] if b - a >= 16)
    return sorted(out)


def candidates(docs: DataFrame, words: list[str]) -> DataFrame:
    """docs(doc_id, text, source, th) -> doc_id, th, start, length, digest, features, named (null: not known).

    A candidate leaves the task as its place and its digest; its characters stay in the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(set(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, text, source, th in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "source", "th")], strict=True):
                    for start, end, named in spans(text or ""):
                        s, lead, tail = text[start:end], text[max(0, start - 48) : start], text[end : end + 32]
                        left, right = _NEAR.findall(lead)[-2:], _NEAR.findall(tail)[:1]
                        near = np.zeros(2 * HASHED)
                        for w in left:
                            near[_slot(w)] = 1
                        for w in right:
                            near[HASHED + _slot(w)] = 1
                        path = np.zeros(HASHED)
                        path[_slot(source or "")] = 1
                        f = [*_shape(s), _covered(s, known), *path, *near]
                        rows.append({"doc_id": doc_id, "th": th, "start": start, "length": len(s), "digest": hashlib.sha256(s.encode()).hexdigest(), "features": f, "named": (True if f[7] > 0 or f[3] > 0.1 else None) if named else False})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return docs.select("doc_id", "text", "source", "th").mapInArrow(run, "doc_id long, th long, start long, length long, digest string, features array<double>, named boolean")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("features", pa.list_(pa.float64())), ("named", pa.bool_())])


@scratched
def judge(found: DataFrame, labelled: DataFrame, *, keep: Scratch) -> DataFrame:
    """found(features, ...) and labelled(features, label 0/1) -> found with score and is_secret."""
    kinds = labelled.filter("label is not null").groupBy("features", "label").agg(F.count("*").cast("double").alias("weight"))
    kinds = keep(kinds)
    counts = {r["label"]: r["n"] for r in kinds.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    no, yes = counts.get(0, 0), counts.get(1, 0)
    part = {0: max(FINDINGS // 2, FINDINGS - yes) / max(no, 1), 1: max(FINDINGS // 2, FINDINGS - no) / max(yes, 1)}
    key = F.pmod(F.xxhash64("features"), F.lit(1 << 30)) / (1 << 30)
    # what is left out of a label counts in the weight of what is taken, so the odds stay those of all findings
    share = F.when(F.col("label") == 1, min(1.0, part[1])).otherwise(min(1.0, part[0]))
    train = keep(kinds.filter(key < share).withColumn("weight", F.col("weight") / share))
    taken = {r["label"] for r in train.select("label").distinct().collect()}  # two rows
    if taken != {0, 1}:
        only = float(taken == {1})
        return found.withColumn("score", F.lit(only)).withColumn("is_secret", F.lit(only > 0))
    train = train.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"), "weight")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", probabilityCol="chance", numTrees=24, maxDepth=6, seed=5, featureSubsetStrategy="onethird").fit(train)
    out = forest.transform(found.withColumn("vector", array_to_vector("features")))
    score = vector_to_array("chance")[1]
    return out.withColumn("score", score).withColumn("is_secret", F.col("score") >= 0.5).drop("vector", "chance", "rawPrediction", "prediction")


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", F.xxhash64("text").alias("th"))


@scratched
def verdicts(docs: DataFrame, *, keep: Scratch) -> DataFrame:
    """docs(doc_id, text, source) -> each candidate's doc_id, th (hash of its text), start, length, digest, features, named, score, is_secret; no secret in plain text."""
    d = _keyed(docs)
    found = keep(candidates(d, dictionary(d)))
    return judge(found, found.select("features", F.col("named").cast("int").alias("label")), keep=keep)


def scan(docs: DataFrame) -> DataFrame:
    """verdicts() and the secret itself, cut from the text when the result is read."""
    texts = _keyed(docs).select("th", "text").dropDuplicates(["th"])
    return verdicts(docs).join(texts, "th").withColumn("secret", F.col("text").substr(F.col("start") + 1, F.col("length"))).drop("text")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each secret in text replaced by the mark, and n_chars, where there, counted again.

    A secret goes wherever it stands in its text; one of letters alone only as a whole word.
    """
    bad = verdicts(docs).filter("is_secret").groupBy("th").agg(F.collect_set(F.struct("start", "length")).alias("at_"))
    columns = docs.columns
    keyed = docs.withColumn("th_", F.xxhash64("text"))
    out = keyed.join(bad.withColumnRenamed("th", "th_"), "th_", "left")
    out = out.withColumn("bad_", F.array_distinct(F.transform("at_", lambda a: F.col("text").substr(a["start"] + 1, a["length"]))))
    clean = F.expr(f"case when bad_ is null then text else aggregate(array_sort(bad_, (x, y) -> length(y) - length(x)), text, (t, s) -> if(s rlike '^[A-Za-z]+$', regexp_replace(t, concat('(?<![A-Za-z])', s, '(?![A-Za-z])'), '{mark}'), replace(t, s, '{mark}'))) end")
    out = out.withColumn("text", clean)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("bad_").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document; secrets are named by their digest only."""
    out = verdicts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.col("digest").alias("secret_sha256"), F.round("score", 6).alias("score"), "is_secret")
