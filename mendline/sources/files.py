"""Readers of logs, sources, SQL models and JSON artifacts.

All readers take paths or globs of any file system Spark reaches and raise Spark's own error for a missing path. Spark passes over
files and folders whose names start with ``_`` or ``.``; those are listed through the same file system here and read by tasks in byte
ranges (``textfiles``). Paths come decoded and in one form.
"""

from __future__ import annotations

import re

from pyarrow.fs import FileSelector, FileType, LocalFileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.sources.textfiles import UNFINISHED, read_named


# What Spark and Hadoop leave beside the files they write.
_BOOKKEEPING = re.compile(r"_SUCCESS$|_temporary$|_committed_|_started_|\..*\.crc$")

def plain_path(path: Column) -> Column:
    """A path as its file system spells it: escapes undone, local ones as ``file:///…``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:///")


def _hidden(spark: SparkSession, paths: str | list[str], glob: str | None) -> list[tuple[str, int, int]]:
    """(path, bytes, time in ms) of the files below ``paths`` that Spark's listing leaves out."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fits = re.compile(jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern(), re.DOTALL) if glob else None
    found = []

    def local(folder: str, below: bool) -> None:
        # Each call of the JVM takes a good part of a millisecond, and a file needs several.
        for info in LocalFileSystem().get_file_info(FileSelector(folder)):
            name = info.base_name
            hidden = below or name[0] in "_."
            if _BOOKKEEPING.match(name) or UNFINISHED.match(name):
                continue
            if info.type == FileType.Directory:
                local(info.path, hidden)
            elif hidden and (fits is None or fits.fullmatch(name)):
                found.append((f"file://{info.path}", info.size, info.mtime_ns // 1_000_000))

    def walk(system, folder, below: bool) -> None:
        for status in system.listStatus(folder):
            name = status.getPath().getName()
            hidden = below or name[0] in "_."
            if _BOOKKEEPING.match(name) or UNFINISHED.match(name):
                continue
            if status.isDirectory():
                walk(system, status.getPath(), hidden)
            elif hidden and (fits is None or fits.fullmatch(name)):
                path = re.sub("^file:/+", "file:///", status.getPath().toString())
                found.append((path, status.getLen(), status.getModificationTime()))

    for p in [paths] if isinstance(paths, str) else paths:
        place = jvm.org.apache.hadoop.fs.Path(p)
        system = place.getFileSystem(conf)
        for status in system.globStatus(place) or []:
            if status.isDirectory() and system.getUri().getScheme() == "file":
                local(status.getPath().toUri().getPath(), False)
            elif status.isDirectory():
                walk(system, status.getPath(), False)
    return found


def read_whole(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, content)``, one row per file. A file must fit in one row (2 GB); use ``read_lines`` beyond that."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    seen = files.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))
    hidden = [(path, size) for path, size, _ in _hidden(spark, paths, glob)]
    return seen.unionByName(read_named(spark, hidden)) if hidden else seen


def log_tail(content: Column, chars: int = R.LOG_TAIL_CHARS, mark: str = R.LOG_TAIL_MARK) -> Column:
    """Content over ``chars`` keeps its end, behind a marker and a blank line."""
    return F.when(
        F.length(content) > chars, F.concat(F.lit(mark + "\n\n"), F.right(content, F.lit(chars)))
    ).otherwise(content)


def source_head(content: Column, chars: int = R.SOURCE_HEAD_CHARS, mark: str = R.SOURCE_HEAD_MARK) -> Column:
    """Content over ``chars`` keeps its start, followed by a blank line and a marker."""
    return F.when(
        F.length(content) > chars, F.concat(F.left(content, F.lit(chars)), F.lit("\n\n" + mark))
    ).otherwise(content)


def read_logs(spark: SparkSession, paths: str | list[str], framework: str = "generic", truncate: bool = False) -> DataFrame:
    """``(path, framework, content)`` of log files, cut to their recent end on request."""
    files = read_whole(spark, paths)
    content = log_tail(F.col("content")) if truncate else F.col("content")
    return files.select("path", F.lit(framework).alias("framework"), content.alias("content"))


def read_sources(spark: SparkSession, paths: str | list[str], glob: str | None = None, truncate: bool = False) -> DataFrame:
    """``(path, content)`` of source files, cut to their start on request."""
    files = read_whole(spark, paths, glob)
    return files.withColumn("content", source_head(F.col("content"))) if truncate else files


def read_lines(spark: SparkSession, paths: str | list[str], exact: bool = False) -> DataFrame:
    """``(path, line_no, text)`` of files of any size, read in splits.

    ``line_no`` orders the lines of a path and has gaps between splits; nothing is shuffled. (The start of a split, in units that no split is smaller than,
    stands before the order in which its task reads it.) ``exact`` numbers the lines from 1: they are sorted within
    their split, and every split adds the line counts of those before it in the same file.
    """
    lines = (
        spark.read.text(paths, lineSep="\n", recursiveFileLookup=True).select(
            plain_path(F.col("_metadata.file_path")).alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("read_order"),
            F.col("value").alias("text"),
        )
    )
    hidden = [(path, size) for path, size, _ in _hidden(spark, paths, None)]
    if hidden:
        lines = lines.unionByName(read_named(spark, hidden, lines=True))
    if not exact:
        in_task = F.col("read_order").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = spark._jsparkSession.sessionState().conf()
        unit = min(1 << 16, sizes.filesMaxPartitionBytes(), sizes.filesOpenCostInBytes())
        place = F.floor(F.col("split") / max(1, unit)) * F.lit(1 << 33) + in_task + 1
        return lines.select("path", place.alias("line_no"), "text")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lines.groupBy("path", "split")
        .agg(F.count("*").alias("n"))
        .select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    in_split = F.row_number().over(Window.partitionBy("path", "split").orderBy("read_order"))
    return (
        lines.withColumn("in_split", in_split)
        .join(offsets, ["path", "split"])
        .select("path", (F.col("in_split") + F.col("offset")).alias("line_no"), "text")
    )


def list_files(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` of all files below a directory, by path. File content is not read."""
    seen = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(directory)
        .select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length", "modificationTime")
    )
    hidden = _hidden(spark, directory, glob)
    more = spark.createDataFrame(hidden, "path string, length bigint, ms bigint")
    return seen.unionByName(more.select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))).orderBy("path")


def read_models(spark: SparkSession, project: str, fall_back: bool = True) -> DataFrame:
    """``(path, name, sql)`` of the SQL files under ``models/``; without that folder, of the project if ``fall_back``."""
    try:
        files = read_whole(spark, f"{project.rstrip('/')}/models", "*.sql")
    except AnalysisException:
        if not fall_back:
            raise
        files = read_whole(spark, project, "*.sql")
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.sql$", 1).alias("name"), F.col("content").alias("sql"))


def read_artifacts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, content, kind)`` of JSON artifacts."""
    from mendline.operators.artifacts import classify_artifacts

    return classify_artifacts(read_whole(spark, paths, "*.json"))
