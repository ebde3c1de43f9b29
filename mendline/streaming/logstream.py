"""The line rules on an append-only stream of log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from mendline.functions.text import strip
from mendline.operators.logs import chain_marks, line_hits


def rule_counts(lines: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Hits per rule and window of ``lines(ts, path, line_no, text)``. State is one counter per rule and open window."""
    hits = line_hits(lines.withWatermark("ts", delay))
    return (
        hits.groupBy(F.window("ts", window).alias("w"), "rule_id")
        .agg(F.count("*").alias("n_hits"))
        .select(F.col("w.start").alias("window_start"), "rule_id", "n_hits")
    )


def first_signatures(lines: DataFrame, delay: str = "10 minutes", parts: int = 16) -> DataFrame:
    """One hit per path, rule and signature; repeats within the watermark are dropped.

    Repeats are dropped within parts of a key first, so the rows of a frequent signature do not all meet in one task.
    """
    key = ["path", "rule_id", "signature"]
    hits = line_hits(lines.withWatermark("ts", delay)).withColumn("_part", F.pmod(F.xxhash64("line_no"), F.lit(parts)))
    return hits.dropDuplicatesWithinWatermark([*key, "_part"]).drop("_part").dropDuplicatesWithinWatermark(key)


class _Chains(StatefulProcessor):
    """The chains of one path. Lines wait until the watermark has passed them, so the order in which they come does not matter.

    State: the lines that wait, the lines of an open chain, and one row of where the path stands. A line that is *hard* cannot continue a
    chain; the first head at or after it begins one.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "line_no bigint", "ts bigint, blank boolean, frame boolean, bare_at boolean, caused boolean, head string, text string")
        self.chain = handle.getListState("chain", "text string")
        self.place = handle.getValueState("place", "after_blank boolean, open boolean, pos bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for df in rows:
            for r in df.itertuples(index=False):
                text = lambda x: None if pd.isna(x) else x
                self.waiting.updateValue((int(r.line_no),), (int(r.ms), bool(r.blank), bool(r.frame), bool(r.bare_at), bool(r.caused), text(r.head), text(r.text)))
                times.add(int(r.ms))
        for t in times:
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k[0], v) for k, v in self.waiting.iterator() if v[0] <= passed)
        after_blank, is_open, pos, last = self.place.get() if self.place.exists() else (False, False, None, None)
        done, lines, new = [], [x[0] for x in self.chain.get()] if is_open and ready else [], False
        for no, (ms, blank, frame, bare_at, caused, head, text) in ready:
            self.waiting.removeKey((no,))
            hard = not (blank or frame or (bare_at and after_blank) or (caused and not after_blank))
            if hard and is_open:
                done.append((pos, "\n".join(lines)))
                is_open, lines, new = False, [], True
            if is_open:
                lines.append(text)
                if not new:
                    self.chain.appendValue((text,))
            elif head is not None:
                is_open, pos, lines, new = True, no, [head], True
            after_blank, last = blank, ms if last is None else max(ms, last)
        if new:
            self.chain.clear()
            if is_open:
                self.chain.put([(x,) for x in lines])
        if is_open and not ready and passed >= last + self.idle_ms:
            done.append((pos, "\n".join(x[0] for x in self.chain.get())))
            is_open = False
            self.chain.clear()
        if ready:
            self.handle.registerTimer(last + self.idle_ms)
        if last is not None:
            self.place.update((after_blank, is_open, pos, last))
        if done:
            yield pd.DataFrame({"path": key[0], "pos": [p for p, _ in done], "chain": [c for _, c in done]})

    def close(self) -> None:
        pass


def exception_chains(lines: DataFrame, delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """``(path, pos, chain)`` of every exception chain of a stream of ``lines(ts, path, line_no, text)``, as ``logs.exception_chains_from_lines`` finds
    them before it counts repeats.

    Lines may come in any order within ``delay``; later ones are dropped. A chain is given out when a line that cannot continue it has passed, or
    when its path has been silent for ``idle_ms``; lines after that begin anew. Line numbers rise with the times. Needs the RocksDB state
    store: ``spark.sql.streaming.stateStore.providerClass``. What a path holds is its lines within the delay and its open chain.
    """
    marked = lines.withWatermark("ts", delay).select(
        "ts", F.unix_millis("ts").alias("ms"), "path", "line_no", *chain_marks(F.col("text")), "text"
    )
    found = marked.groupBy("path").transformWithStateInPandas(
        statefulProcessor=_Chains(idle_ms), outputStructType="path string, pos bigint, chain string", outputMode="Append", timeMode="EventTime"
    )
    return found.withColumn("chain", strip(F.col("chain")))


def read_line_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder as a stream of lines."""
    return spark.readStream.schema(schema).parquet(folder)
