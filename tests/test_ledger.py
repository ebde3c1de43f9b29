import os

import pytest
from pyspark.sql import functions as F

from mendline.operators import ledger
from mendline.sources import files


def found(texts):
    """A finding for every file with an x."""
    return texts.filter("content like '%x%'").select(
        F.lit("log").alias("family"), F.col("path").alias("artifact"), F.lit("has_x").alias("rule_id"), F.lit("NOTE").alias("severity"),
        F.length("content").cast("bigint").alias("n"), F.left("content", F.lit(9)).alias("evidence"),
    )


def write(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def test_only_changed_files_are_read(spark, tmp_path, rows):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        write(src, f"f{i}.txt", f"x{i}" if i % 2 else "y", 1000)
    write(src, "_hidden.txt", "xx", 1000)
    read = []
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", lambda texts: found(texts.transform(lambda t: read.append(t) or t)))
    listing = lambda: files.list_files(spark, str(src), "*.txt")
    shown = lambda: rows(book.findings().select(F.element_at(F.split("artifact", "/"), -1), "evidence"))
    assert shown() == [] and book.update(listing()) == 7
    assert shown() == [("_hidden.txt", "xx"), ("f1.txt", "x1"), ("f3.txt", "x3"), ("f5.txt", "x5")]
    assert book.update(listing()) == 0 and len(read) == 1, "nothing is read when nothing has changed"
    write(src, "f1.txt", "y", 2000)  # loses its finding
    write(src, "f2.txt", "x new", 2000)
    write(src, "f3.txt", "xx3", 2000)
    (src / "f5.txt").unlink()
    assert book.update(listing()) == 3
    assert sorted(r.path.split("/")[-1] for r in read[-1].collect()) == ["f1.txt", "f2.txt", "f3.txt"]
    want = [("_hidden.txt", "xx"), ("f2.txt", "x new"), ("f3.txt", "xx3")]
    assert shown() == want
    book.compact()
    assert shown() == want and len(book._batches()) == 1 and book.update(listing()) == 0
    write(src, "f5.txt", "x again", 3000)
    assert book.update(listing()) == 1 and ("f5.txt", "x again") in shown()
    for p in src.iterdir():
        p.unlink()
    assert book.update(listing()) == 0 and shown() == []


def test_a_lost_update_is_not_seen(spark, tmp_path, rows):
    src = tmp_path / "src"
    src.mkdir()
    write(src, "a.txt", "x", 1000)
    listing = files.list_files(spark, str(src), "*.txt")

    def broken(texts):
        return found(texts).withColumn("evidence", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        ledger.Ledger(spark, f"file://{tmp_path}/ledger", broken).update(listing)
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", found)
    assert book.findings().collect() == [] and book.update(listing) == 1 and book.findings().count() == 1
