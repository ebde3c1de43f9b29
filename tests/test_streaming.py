import datetime
import random
from collections import Counter

import pytest

from mendline.operators import logs
from mendline.streaming import logstream

SCHEMA = "ts timestamp, path string, line_no bigint, text string"


def lines(day, *texts):
    return [(datetime.datetime(2024, 1, day, 0, i), "a.log", i, t) for i, t in enumerate(texts)]


def run(spark, tmp_path, build, name):
    folder = str(tmp_path / "in")
    spark.createDataFrame(lines(1, "FetchFailed", "FetchFailed", "INFO x", "WARN A: b", "executor 1 lost"), SCHEMA).write.mode("append").parquet(folder)
    stream = build(logstream.read_line_stream(spark, folder, SCHEMA))
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
        # A later day closes the windows of the first.
        spark.createDataFrame(lines(2, "straggler"), SCHEMA).write.mode("append").parquet(folder)
        query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_rule_counts(spark, tmp_path):
    found = run(spark, tmp_path, logstream.rule_counts, "counts")
    assert sorted((r.rule_id, r.n_hits) for r in found) == [("executor_loss", 1), ("shuffle_failure", 2), ("warn_line", 1)]


def test_first_signatures(spark, tmp_path):
    found = run(spark, tmp_path, logstream.first_signatures, "firsts")
    assert sorted(r.rule_id for r in found if r.ts.day == 1) == ["executor_loss", "shuffle_failure", "warn_line"]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_chains_of_a_stream_are_those_of_the_lines(spark, tmp_path, rocks):
    """Lines in any order, over several batches; the last trace of a path ends by silence."""
    r = random.Random(3)
    kinds = [
        "java.lang.IllegalStateException: a", "\tat com.acme.A.b(A.java:1)", "\tat com.acme.C.d(C.java:2)", "Caused by: java.io.IOException: x", "at late.frame(X.java:3)",
        "", "INFO plain", "ERROR org.apache.spark.SparkException: boom", "24/01/01 text", "Caused by: nothing",
    ]
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for path in ("a.log", "b.log", "c.log"):
        texts = [r.choice(kinds) for _ in range(60)] + ["java.lang.Error: last", "\tat end.of(File.java:1)"]
        rows += [(start + datetime.timedelta(seconds=20 * i), path, i, t) for i, t in enumerate(texts)]
    want = Counter()
    for x in logs.exception_chains_from_lines(spark.createDataFrame(rows, SCHEMA), block_lines=7).collect():
        want[x.path, x.pos, x.chain] = x.n_repeats
    r.shuffle(rows)
    folder, out = str(tmp_path / "in"), Counter()
    parts = [rows[:70], rows[70:130], rows[130:], lines(5, "INFO later"), lines(6, "INFO much later")]
    spark.createDataFrame(parts[0], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = logstream.exception_chains(logstream.read_line_stream(spark, folder, SCHEMA), delay="1 hour", idle_ms=60_000)
    query = stream.writeStream.format("memory").queryName("chains").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        for p in parts[1:]:
            spark.createDataFrame([(t, "z.log" if t.day > 4 else path, n, x) for t, path, n, x in p], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        found = spark.table("chains").collect()
    finally:
        query.stop()
    for x in found:
        out[x.path, x.chain] += 1
    first = {}
    for x in found:
        first[x.path, x.chain] = min(x.pos, first.get((x.path, x.chain), x.pos))
    assert {(p, first[p, c], c): n for (p, c), n in out.items()} == dict(want) and len(want) > 10
