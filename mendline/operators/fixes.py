"""Literal text fixes applied to a corpus in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions.scale import cut
from mendline.sources.textfiles import write_named


def _order(fixes: DataFrame) -> DataFrame:
    """Fixes of a file come in order of ``position``; without that column, and among equals, by their texts."""
    position = F.col("position").cast("bigint") if "position" in fixes.columns else F.lit(0).cast("bigint")
    return fixes.select("path", position.alias("position"), "original", "replacement")


def _applied(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(path, content, changed, done)`` of every file that a fix names: the text after all of them, and each one's status.

    The fixes of a file are gathered first, as they build on one another. Only their small table is hashed or broadcast; texts
    are not sorted.
    """
    listed = _order(fixes).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("position", "original", "replacement"))).alias("todo"))
    met = files.select("path", "content").join(listed.hint("shuffle_hash"), "path")

    def apply(state: Column, fix: Column) -> Column:
        at = F.instr(state["content"], fix["original"])
        status = F.when(at == 0, "not_found").when(fix["original"] == fix["replacement"], "identical").otherwise("applied")
        new = F.overlay(state["content"], fix["replacement"], at, F.length(fix["original"]))
        return F.struct(
            F.when(status == "applied", new).otherwise(state["content"]).alias("content"),
            F.concat(state["done"], F.array(status)).alias("done"),
        )

    start = F.struct(F.col("content").alias("content"), F.array().cast("array<string>").alias("done"))
    after = met.select("path", "todo", F.aggregate("todo", start, apply).alias("s"))
    return after.select(
        "path",
        F.col("s.content").alias("content"),
        F.size(F.filter("s.done", lambda x: x == "applied")).alias("n_applied"),
        F.arrays_zip(F.col("todo").alias("fix"), F.col("s.done").alias("status")).alias("done"),
    )


def apply_fixes(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(path, position, original, replacement, status)``: one row per row of ``fixes(path, original, replacement[, position])``.

    The first verbatim occurrence of ``original`` in ``files(path, content)`` is replaced. Each fix of a file meets the text that those before
    it left. ``status`` is file_missing, not_found, identical or applied.
    """
    met = _applied(files, fixes).select("path", F.explode("done").alias("d"))
    found = met.select("path", "d.fix.position", "d.fix.original", "d.fix.replacement", "d.status")
    gone = _order(fixes).join(files.select("path").distinct(), "path", "left_anti")
    return found.unionByName(gone.withColumn("status", F.lit("file_missing")))


def fixed_files(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(path, content, n_applied)`` of the files that the fixes change, with all of a file's fixes in its text."""
    return _applied(files, fixes).filter("n_applied > 0").select("path", "content", F.col("n_applied").cast("bigint").alias("n_applied"))


def write_back(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``apply_fixes``, with the changed texts written to their files.

    Files take their new texts when all of them are written; ``textfiles.write_named`` says how. The statuses are those of the texts as they were.
    """
    done = cut(apply_fixes(files, fixes))
    write_named(fixed_files(files, fixes))
    return done
