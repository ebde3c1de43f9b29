"""Token counts kept as delta-maintained rollups.

A change is a signed count: an insert adds the tokens of a document under (source, language, tokenizer version), a delete takes away what
was added, and a revised count is a delete of the old and an insert of the new. A batch of changes is summed to a delta before
anything is shuffled, and committed under its batch id: the delta is written beside the earlier ones in the shared folder, and
its success file makes it count. A batch whose id is committed is not written again, and one whose writer was lost before the end is
overwritten by the next try, so repeats change nothing. Totals are the sum of the committed deltas; ``compact`` folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.llm.common import narrow, shared_path, small_batches
from mendline.llm.piece_dropout import MODEL, Pieces, _model

KEYS = ("source", "lang", "version")
TOTALS = ("n_docs", "n_tokens", "n_chars")
#: The tokenizer version of words between ASCII blanks.
WORDS = "ascii-words"
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"


def version(model: str = MODEL) -> str:
    """The tokenizer version of a model file: another model never has the same, wherever it lies."""
    with open(model, "rb") as f:
        return f"pieces-{hashlib.file_digest(f, 'sha256').hexdigest()[:16]}"


def counted(docs: DataFrame, text: Column | None = None, model: str = MODEL) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens, n_chars): two rows per row of ``docs``, one for each tokenizer version.

    ``text`` is the text to count, if not the column of that name; null counts as empty. Null sources and languages are kept as such.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = _model(spark, model)
    body = F.col("text") if text is None else text
    d = narrow(docs, "doc_id", "source", "lang", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(body.cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(held.value, 0.0, 0)
        for b in batches:
            texts = b.column(3).to_pylist()
            n = [len(x) // 4 for x in pieces.encode_many(texts, [0] * len(texts))]
            words = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
            numbers = [pa.array(x, pa.int64()) for x in (n, words, list(map(len, texts)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *numbers], names=["doc_id", "source", "lang", "pieces", "words", "n_chars"])

    found = d.mapInArrow(run, "doc_id long, source string, lang string, pieces long, words long, n_chars long")
    both = F.array(
        F.struct(F.lit(version(model)).alias("version"), F.col("pieces").alias("n_tokens")),
        F.struct(F.lit(WORDS).alias("version"), F.col("words").alias("n_tokens")),
    )
    return found.select("doc_id", "source", "lang", "n_chars", F.inline(both)).select(
        "doc_id", "source", "lang", "version", "n_tokens", "n_chars"
    )


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Inserts (1) or deletes (-1) of counted documents."""
    return counts.withColumn("sign", F.lit(sign))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deletes of the old counts and inserts of the new; rows that did not change cancel out in the delta."""
    return signed(old, -1).unionByName(signed(new, 1))


def delta(changes: DataFrame) -> DataFrame:
    """The sum of signed changes by source, language and version; keys whose changes cancel have no row."""
    sums = changes.groupBy(*KEYS).agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"),
        *[F.sum(F.col(c) * F.col("sign")).cast("long").alias(c) for c in TOTALS[1:]],
    )
    return sums.filter(" or ".join(f"{c} <> 0" for c in TOTALS))


class Rollup:
    """Totals in a folder that all executors share. One writer commits at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "token-counts")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _names(self, folder: str) -> list[str]:
        if not self._exists(folder):
            return []
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in system.listStatus(place))

    def committed(self) -> list[str]:
        """Ids of the batches that count, those folded into a base among them."""
        names = [n for n in self._names(f"{self.path}/deltas") if self._exists(f"{self.path}/deltas/{n}/_SUCCESS")]
        return [n.removeprefix("batch=") for n in names]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if its id is committed already, when nothing is computed."""
        if not batch or any(c in batch for c in "/=:"):
            raise ValueError("a batch id has no / = or :")
        place = f"{self.path}/deltas/batch={batch}"
        if self._exists(f"{place}/_SUCCESS"):
            return False
        delta(changes).write.mode("overwrite").parquet(place)
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base that is complete, and the batches in it."""
        for name in reversed(self._names(f"{self.path}/bases")):
            place = f"{self.path}/bases/{name}"
            if self._exists(f"{place}/totals/_SUCCESS") and self._exists(f"{place}/batches/_SUCCESS"):
                return place, {r[0] for r in self.spark.read.parquet(f"{place}/batches").collect()}
        return None, set()

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens, n_chars) over all committed batches; keys without documents have no row."""
        base, folded = self._base()
        parts = [f"{self.path}/deltas/batch={b}" for b in self.committed() if b not in folded] + ([f"{base}/totals"] if base else [])
        if not parts:
            return self.spark.createDataFrame([], _DELTA)
        sums = self.spark.read.schema(_DELTA).parquet(*parts).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS])
        return sums.filter(" or ".join(f"{c} <> 0" for c in TOTALS))

    def compact(self) -> None:
        """Fold all committed deltas into a new base. The deltas stay, so a loss half-way changes no total."""
        batches = self.committed()
        number = len(self._names(f"{self.path}/bases"))
        place = f"{self.path}/bases/{number:09d}"
        self.totals().write.mode("overwrite").parquet(f"{place}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").parquet(f"{place}/batches")


#: Secrets as they stand in texts; a revision of the corpus takes their values out.
SECRET = "(?i)(password=|token = \")[0-9a-f]+"
BRIEF = 20


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SECRET, "$1removed")


def maintained(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Totals after three batches over all of ``docs``.

    All documents are inserted; those that hold secrets are revised to their redacted text; of those as they are then, the ones of
    under BRIEF characters are deleted. Every batch is delivered twice, which changes nothing.
    """
    rollup = Rollup(docs.sparkSession, path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    secret = docs.filter(text.rlike(SECRET))
    brief = docs.filter(F.length(redacted(F.col("text"))) < BRIEF)
    batches = {
        "load": signed(counted(docs), 1),
        "redact": revised(counted(secret), counted(secret, redacted(F.col("text")))),
        "withdraw": signed(counted(brief, redacted(F.col("text"))), -1),
    }
    for name, changes in batches.items():
        rollup.commit(name, changes)
        rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()
