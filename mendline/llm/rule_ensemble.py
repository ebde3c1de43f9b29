"""Quality classifier as a sparse rule ensemble.

Statistics of a text come from one pass over its bytes. A forest of shallow trees over them is fitted on a bounded sample of labelled rows;
every path of a tree is a conjunctive rule. A logistic model with an L1 penalty over the rules keeps few of them, and those
are compiled into one column expression, so that scoring is a projection on the scan of the documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.llm.common import crc_mod, small_batches, text_and_id, unused

#: Columns of the statistics, all doubles and never null.
STATISTICS = (
    "chars words mean_word distinct_share lines distinct_line_share upper_share digit_share mark_share symbol_share "
    "bang_share bar_share sentence_words"
).split()


def text_statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, on its UTF-8 bytes: bytes above 127 count as letters. Shares are of bytes, words or lines."""
    body = text.encode("utf-8", "surrogatepass")
    words, lines = body.split(), [x for x in body.split(b"\n") if x]
    n, chars = len(words), len(body)
    seen = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    of = lambda marks: float(seen[list(marks)].sum()) / max(chars, 1)
    return (
        math.log1p(chars),
        math.log1p(n),
        (chars - int(seen[_BLANK].sum())) / max(n, 1),
        len(set(words)) / max(n, 1),
        math.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        of(_UPPER),
        of(b"0123456789"),
        of(b".,;:!?"),
        of(_SYMBOLS),
        of(b"!"),
        of(b"|"),
        math.log1p(n / max(1, int(seen[ord(".")]))),
    )


_BLANK = list(b" \t\n\v\f\r")
_UPPER = bytes(range(65, 91))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?")


def with_statistics(docs: DataFrame, name: str = "__stats") -> DataFrame:
    """``docs`` and a struct of statistics of its text; a null text counts as empty."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{c} double" for c in STATISTICS))
    def measured(texts: pa.Array) -> pa.Array:
        rows = np.array([text_statistics(t.as_py() or "") for t in texts], float).reshape(-1, len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], names=STATISTICS)

    return docs.withColumn(name, measured(docs["text"].cast("string")))


@dataclass(frozen=True)
class Rule:
    """A conjunction: each condition is (statistic, above, threshold), held if value > threshold is ``above``."""

    conditions: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: str = "") -> Column:
        out = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.col(of + name)
            out = out & (value > threshold if above else value <= threshold)
        return out


    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        """The same over the sample."""
        out = np.ones(len(rows), bool)
        for name, above, threshold in self.conditions:
            out &= (rows[name] > threshold) == above
        return out


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[Rule, ...]
    intercept: float

    def score(self, of: str = "") -> Column:
        """Probability of label 1, over the columns named in STATISTICS (those of the struct ``of``, as in "s.")."""
        total = F.lit(float(self.intercept))
        for r in self.rules:
            total = total + F.when(r.column(of), float(r.weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _paths(node, names, held=()):
    """Conjunctions of all nodes of a tree but the root: inner nodes are rules as well as leaves."""
    if held:
        yield held
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, threshold = names[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), names, (*held, (name, False, threshold)))
        yield from _paths(node.rightChild(), names, (*held, (name, True, threshold)))


def _shorter(path: tuple) -> tuple:
    """A path with at most one bound of each side for a statistic, in fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, t in path:
        k = (name, above)
        best[k] = t if k not in best else max(best[k], t) if above else min(best[k], t)
    return tuple(sorted((n, a, t) for (n, a), t in best.items()))


def labelled(labels: DataFrame, label: str, hold_mod: int, hold_rest: int, most: int, seed: int) -> DataFrame:
    """(doc_id, y): at most ``most`` training rows, those of the smallest keyed hash. Rows held out are never among them.

    A document labelled twice counts as 1 if most of its labels are. Null labels and ids are left out.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).dropna()
    one = one.filter(crc_mod("doc_id", hold_mod) != hold_rest)
    one = one.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    return one.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and constant of the least mean logistic loss plus ``penalty`` times the sum of absolute weights.

    Accelerated proximal steps on the bounded sample; the constant is not penalised.
    """
    z = np.column_stack([np.ones(len(x)), x])
    step = 4 * len(z) / max(float(np.linalg.eigvalsh(z.T @ z)[-1]), 1e-9)
    now = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -35, 35)))
        new = ahead - step * (z.T @ (p - y)) / len(z)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - now)
        now = new
    return now[1:], float(now[0])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    hold_mod: int = 5,
    hold_rest: int = 0,
    sample: int = 12_000,
    trees: int = 16,
    depth: int = 3,
    penalty: float = 0.002,
    seed: int = 11,
) -> Ensemble:
    """Fit on at most ``sample`` labelled rows; their statistics, a few numbers each, are what the driver holds.

    Without labelled rows, or with one class only, the model is the (smoothed) share of label 1 and has no rules.
    """
    spark = docs.sparkSession
    train = labelled(labels, label, hold_mod, hold_rest, sample, seed)
    texts = text_and_id(docs)
    # The sample has at most ``sample`` rows of two numbers: a broadcast of known size, so no text is shuffled.
    found = with_statistics(texts.join(F.broadcast(train), "doc_id")).select("doc_id", "y", "__stats.*")
    rows = found.toArrow().to_pandas().drop_duplicates(["doc_id"]).sort_values("doc_id")
    positive = float(rows["y"].sum())
    prior = math.log((positive + 1) / (len(rows) - positive + 1))
    if rows["y"].nunique() < 2:
        return Ensemble((), prior)
    sampled = spark.createDataFrame(pa.Table.from_pandas(rows, preserve_index=False)).coalesce(2)
    assembled = VectorAssembler(inputCols=STATISTICS, outputCol="__x").transform(sampled)
    forest = RandomForestClassifier(
        labelCol="y", featuresCol="__x", numTrees=trees, maxDepth=depth, minInstancesPerNode=5,
        featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed,
    ).fit(assembled)
    paths = {_shorter(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode(), STATISTICS)}
    rules = [Rule(p) for p in sorted(paths)]
    if not rules:
        return Ensemble((), prior)
    matrix = np.stack([r.holds(rows) for r in rules], axis=1).astype(float)
    weights, intercept = lasso(matrix, rows["y"].to_numpy(), penalty)
    kept = tuple(Rule(r.conditions, float(w)) for r, w in zip(rules, weights) if w)
    return Ensemble(kept, intercept)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Ensemble | None = None, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; empty and null texts are scored as empty."""
    model = model or fit(docs, labels, **how)
    mod, rest = how.get("hold_mod", 5), how.get("hold_rest", 0)
    return (
        with_statistics(text_and_id(docs))
        .select("doc_id", F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False)).alias("held_out"), model.score("__stats.").alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """``docs`` without the documents that the classifier rejects (score below ``threshold``).

    Null and empty texts are scored as empty, repeated rows alike. Without labelled rows nothing is rejected. No rows give no rows.
    """
    model = fit(docs, labels, **how)
    name = unused(docs, "stats")
    return with_statistics(docs, name).filter(model.score(f"{name}.") >= threshold).drop(name)
