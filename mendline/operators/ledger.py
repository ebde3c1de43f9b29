"""Findings kept up to date: only files that are new or changed are read again.

A ledger holds the versions (length, time of change) of the files that were looked at. An update compares them with a listing, reads the files whose
version is new, and writes their findings and versions as one batch; the findings of a file are those of its last batch, so a changed file
replaces exactly its own, and a file that is gone loses them. A batch counts once the success file of its versions is there:
an update that was lost before leaves nothing that is seen, and the next one writes it again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.functions.scale import cut, cut_counted
from mendline.operators.findings import COLUMNS
from mendline.sources.textfiles import read_texts

_VERSIONS = "path string, length bigint, modificationTime timestamp, gone boolean, batch bigint"
_FINDINGS = "family string, artifact string, rule_id string, severity string, n bigint, evidence string, batch bigint"


class Ledger:
    """Versions and findings in a folder that all executors share; ``rules`` turns ``(path, content)`` into findings whose artifact is the path."""

    def __init__(self, spark: SparkSession, folder: str, rules: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _batches(self) -> list[str]:
        """Committed batches since the last that holds all, in order: a name for each update."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(place):
            return []
        names = sorted(f.getPath().getName() for f in system.listStatus(place))
        done = [n for n in names if system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/versions/_SUCCESS"))]
        whole = [i for i, n in enumerate(done) if n.endswith("-all")]
        return done[whole[-1] if whole else 0 :]

    def _read(self, kind: str, schema: str) -> DataFrame:
        places = [f"{self.folder}/{n}/{kind}" for n in self._batches()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def versions(self) -> DataFrame:
        """``(path, length, modificationTime, batch)`` of the files that the findings are of."""
        last = self._read("versions", _VERSIONS).groupBy("path").agg(F.max_by(F.struct("length", "modificationTime", "gone", "batch"), "batch").alias("v"))
        return last.select("path", "v.*").filter("not gone").drop("gone")

    def findings(self) -> DataFrame:
        """The findings of the last version of every file."""
        of = self.versions().select(F.col("path").alias("artifact"), "batch")
        return self._read("findings", _FINDINGS).join(of, ["artifact", "batch"], "left_semi").select(*COLUMNS)

    def update(self, listing: DataFrame) -> int:
        """Look at the files of ``listing(path, length, modificationTime)`` that are new or changed; returns how many were read."""
        known = cut(self.versions())
        now = listing.select("path", "length", "modificationTime").dropDuplicates(["path"])
        changed, n = cut_counted(now.join(known, ["path", "length", "modificationTime"], "left_anti"))
        gone, n_gone = cut_counted(known.join(now, "path", "left_anti").select("path", "length", "modificationTime"))
        if n or n_gone:
            batch = 1 + int(self._batches()[-1].split("-")[0]) if self._batches() else 1
            self._write(batch, "", self.rules(read_texts(changed)), changed.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))))
        return n

    def _write(self, batch: int, mark: str, findings: DataFrame, versions: DataFrame) -> None:
        at, number = f"{self.folder}/{batch:010d}{mark}", F.lit(batch).cast("bigint")
        findings.select(*COLUMNS).withColumn("batch", number).write.mode("overwrite").parquet(f"{at}/findings")
        versions.select("path", "length", "modificationTime", "gone").withColumn("batch", number).write.mode("overwrite").parquet(f"{at}/versions")

    def compact(self) -> None:
        """One batch that holds everything, from which later readings start."""
        if batches := self._batches():
            batch = 1 + int(batches[-1].split("-")[0])
            self._write(batch, "-all", cut(self.findings()), cut(self.versions().withColumn("gone", F.lit(False))))
