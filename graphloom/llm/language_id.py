"""Language identification by error-correcting output codes (operator 7).

Each language has a codeword. For each bit a binary classifier weighs hashed byte trigrams of the
lower-cased text by the log ratio of their share in the languages with and without the bit (languages
weigh the same, whatever their size). A text's margin for a bit is the mean weight over all its trigrams,
times the square root of their number up to SURE. Decoding adds the logistic loss of the margins against
each codeword; the smallest total loss wins, the score is its share of exp(-loss), and texts whose two
best losses lie within CLOSE of each other are flagged ambiguous.

Trigram counts cover all learning rows. The tables hold SLOTS numbers for each language.

Defined results: null texts and texts without a letter are "und" with score 0; ties go to the first
language in code-point order; a null doc_id counts as remainder 0 (not held out, learned from); with no
learned language every text is "und"; repeated rows are rows of their own; extra columns are dropped.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import pick, read

SLOTS, SURE, CLOSE, SMOOTH = 1 << 15, 400, 0.1, 0.5
_LETTER = re.compile(r"[^\W\d_]")


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all different splits for up to 5 languages, else the best of random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1)]
        return np.array([s for s in splits if -1 in s]).T.astype(float)
    bits = 8 * int(np.ceil(np.log2(n)))
    rng, best = np.random.default_rng(3), (-1, None)
    for _ in range(200):
        c = rng.integers(0, 2, (n, bits)) * 2 - 1
        c = c[:, np.abs(c.sum(0)) < n]  # a bit that all languages share says nothing
        d = (c.shape[1] - c @ c.T)[~np.eye(n, dtype=bool)].min()
        best = max(best, (int(d), c), key=lambda x: x[0])
    return best[1].astype(float)


def trigrams(text: str) -> np.ndarray:
    raw = f" {text.lower()} ".encode()
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (h * np.uint32(2654435761)) >> np.uint32(17)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def trigram_counts(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> lang, slot, n; summed inside tasks first, so a task sends SLOTS rows a language at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        seen.setdefault(lang, np.zeros(SLOTS, np.int64))
                        slots = trigrams(text)
                        if len(slots) < 2000:
                            np.add.at(seen[lang], slots, 1)
                        else:
                            seen[lang] += np.bincount(slots, minlength=SLOTS)
        for lang, n in seen.items():
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots), pa.array(n[slots])], ["lang", "slot", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, docs: DataFrame):
        """docs(lang, text): the learning rows, lang not null."""
        t = trigram_counts(docs).toArrow()  # SLOTS rows a language at most
        langs, slots, n = t["lang"].to_pylist(), t["slot"].to_numpy(), t["n"].to_numpy()
        self.langs = sorted(set(langs))
        place = {x: i for i, x in enumerate(self.langs)}
        counts = np.zeros((len(self.langs), SLOTS))
        counts[[place[x] for x in langs], slots] = n
        share = (counts + SMOOTH) / (counts + SMOOTH).sum(1, keepdims=True) if len(self.langs) else counts
        self.code = codewords(len(self.langs))
        on = self.code > 0
        weight = np.zeros((SLOTS, self.code.shape[1]), np.float32)
        for j in range(self.code.shape[1] if len(self.langs) > 1 else 0):
            weight[:, j] = np.log(share[on[:, j]].mean(0) / share[~on[:, j]].mean(0))
        self.weight = weight

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text) -> doc_id, lang_pred, score, ambiguous; a map over rows."""
        shared = docs.sparkSession.sparkContext.broadcast((self.langs, self.code, self.weight))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, code, weight = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    texts = part.column(1).to_pylist()
                    ok = np.array([bool(langs) and has_letter(t) for t in texts], bool)
                    margin = np.zeros((len(texts), code.shape[1] if langs else 1))
                    for i in np.flatnonzero(ok):
                        slots = trigrams(texts[i])
                        total = sum(weight[slots[k : k + 16384]].sum(0, dtype=np.float64) for k in range(0, len(slots), 16384))
                        margin[i] = total / len(slots) * np.sqrt(min(len(slots), SURE))
                    pred, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                    if langs:
                        loss = np.logaddexp(0, -margin[:, None, :] * code[None]).sum(2)
                        best = loss.argmin(1)
                        gap = np.exp(loss.min(1, keepdims=True) - loss)
                        top = 1 / gap.sum(1)
                        second = np.sort(loss, 1)[:, 1] if len(langs) > 1 else np.full(len(texts), np.inf)
                        for i in np.flatnonzero(ok):
                            pred[i], score[i], close[i] = langs[best[i]], top[i], second[i] - loss[i].min() < CLOSE
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole text of documents."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = LanguageModel(docs.filter(~held_out() & F.col("lang").isNotNull()))
    return model.predict(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
