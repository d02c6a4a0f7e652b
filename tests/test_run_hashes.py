from pyspark.sql import functions as F

from graphloom.plans.retrieval import runs


def test_words_are_hashed_once_and_runs_stay_apart(spark):
    texts = ["a b c d e", "a b c d e a b c d e", "a  b c d", "a b  c d", "ab c d e f", "a bc d e f", "a b c d", "", None, "e d c b a", "x x x x x x x", "ß é 漢 a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = docs.select("doc_id", runs(F.col("text")).alias("s"))
    assert "transform(split(" in df._jdf.queryExecution().analyzed().toString()  # words become numbers before they meet in runs
    got = {r.doc_id: r.s for r in df.collect()}
    want = {i: list(dict.fromkeys(tuple(w[j : j + 5]) for j in range(len(w) - 4))) for i, w in ((i, (t or "").split(" ")) for i, t in enumerate(texts))}
    pairs = {(h, w) for i in got for h, w in zip(got[i], want[i], strict=True)}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})
