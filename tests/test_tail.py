import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.frames import shared_folder
from graphloom.streaming import tail


@pytest.fixture
def place(spark):
    base = f"{shared_folder(spark)}/tail-{uuid.uuid4()}"
    os.makedirs(f"{base}/in/sub")
    return f"{base}/in", f"{base}/out"


def put(path, text, mode="a"):
    with open(path, mode + "b") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def lines(spark, out):
    return sorted((os.path.basename(r.path), r.line, r.value) for r in tail.tailed(spark, out).collect())


def test_appended_lines_appear_once_and_half_lines_wait(spark, place):
    folder, out = place
    a, b = f"{folder}/a.jsonl", f"{folder}/sub/b.jsonl"
    put(a, "one\ntwo\nthr"), put(b, "ü\n\nx\n"), put(f"{folder}/c.txt", "no\n")
    assert lines(spark, out) == []
    assert tail.tick(spark, folder, out, 0, quiet=0) is True
    want = [("a.jsonl", 1, "one"), ("a.jsonl", 2, "two"), ("b.jsonl", 1, "ü"), ("b.jsonl", 2, ""), ("b.jsonl", 3, "x")]
    assert lines(spark, out) == want
    assert tail.tick(spark, folder, out, 0, quiet=0) is False  # a finished tick is left alone
    tail.tick(spark, folder, out, 1, quiet=0)  # nothing new
    assert lines(spark, out) == want
    put(a, "ee\nfour\n"), put(b, "é".encode()[:1])
    tail.tick(spark, folder, out, 2, quiet=0)
    want += [("a.jsonl", 3, "three"), ("a.jsonl", 4, "four")]
    assert lines(spark, out) == sorted(want)
    put(b, "é".encode()[1:] + b"\n")  # the other half of a letter, and the line's end
    tail.tick(spark, folder, out, 3, quiet=0)
    assert lines(spark, out) == sorted([*want, ("b.jsonl", 4, "é")])


def test_broken_ticks_are_replaced(spark, place):
    folder, out = place
    put(f"{folder}/a.jsonl", "one\n")
    tail.tick(spark, folder, out, 0, quiet=0)
    put(f"{folder}/a.jsonl", "two\n")
    # a tick that died after its rows: they do not count, and the next run of that number writes them anew
    spark.createDataFrame([("x", 9, "stale")], tail.ROWS).write.parquet(f"{out}/rows/tick=1")
    assert [r[2] for r in lines(spark, out)] == ["one"]
    put(f"{folder}/a.jsonl", "three\n")
    tail.tick(spark, folder, out, 1, quiet=0)
    assert [r[2] for r in lines(spark, out)] == ["one", "two", "three"]


def test_live_lately_changed_and_shorter_files(spark, place):
    folder, out = place
    put(f"{folder}/live.jsonl", "a\n"), put(f"{folder}/new.jsonl", "b\n"), put(f"{folder}/old.jsonl", "c\nd\n")
    past = time.time() - 100
    os.utime(f"{folder}/old.jsonl", (past, past)), os.utime(f"{folder}/live.jsonl", (past, past))
    tail.tick(spark, folder, out, 0, live="live")
    assert [r[2] for r in lines(spark, out)] == ["c", "d"]
    put(f"{folder}/old.jsonl", "e\n", "w")  # replaced by a shorter one
    os.utime(f"{folder}/old.jsonl", (past + 10, past + 10))
    tail.tick(spark, folder, out, 1, live="live", now=F.current_timestamp() + F.expr("interval 1 hour"))
    assert lines(spark, out) == [("new.jsonl", 1, "b"), ("old.jsonl", 1, "c"), ("old.jsonl", 2, "d"), ("old.jsonl", 3, "e")]


def test_stream_of_ticks_goes_on_after_a_restart(spark, place):
    folder, out = place
    for k in range(2):
        put(f"{folder}/a.jsonl", "".join(f"{k}-{i}\n" for i in range(50)))
        q = tail.follow_tail(spark, folder, out, f"{out}/check", "1 second", quiet=0)
        end = time.time() + 60
        while time.time() < end and len(lines(spark, out)) < 50 * (k + 1):
            time.sleep(0.5)
        q.stop()
    assert [r[2] for r in lines(spark, out)] == [f"{k}-{i}" for k in range(2) for i in range(50)]
