"""Toxicity by maximum-scoring segments.

Every token has a log-odds weight between toxic and clean labelled documents, with an informative Dirichlet prior from all of them;
weights are shrunk by their standard error, and a small drift makes the expected weight of clean text negative. Tokens are
counted in a fixed number of hash buckets, so the model has one size whatever the vocabulary. A linear scan over the weights of a
text finds all maximal-scoring segments. For clean text the best segment of n tokens follows an extreme-value law: the expected
number of segments scoring S or more is K n exp(-lambda S), with lambda from the weights of clean tokens and K from
the best segments of clean documents. Segments whose expected number is small are the toxic passages; their surprises are
combined into the score of the document by a logistic curve fitted on documents that did not shape the weights they are scored with.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendline.llm.common import crc_mod, cut, small_batches, text_and_id
from mendline.llm.rule_ensemble import labelled

BUCKETS = 1 << 18
_TOKEN = re.compile(r"[^\W\d_]+")
_BLOCK = 1 << 20
_KEPT = 500_000


def _blocks(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a long text, cut at blanks."""
    start = 0
    while start < len(text):
        end = start + _BLOCK
        blank = text.find(" ", end) if end < len(text) else -1
        end = blank if blank >= 0 else len(text)
        yield start, text[start:end]
        start = end


def bucket(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class _Buckets(dict):
    """token -> bucket, kept up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        b = self[token] = bucket(token)
        return b


def token_buckets(text: str, known: _Buckets) -> np.ndarray:
    """Buckets of the tokens of a text: runs of letters, lower-cased."""
    parts = [np.array([known[t] for t in map(str.lower, _TOKEN.findall(part))], np.int64) for _, part in _blocks(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, one past the last, score), by one pass over the positive weights.

    A candidate holds the sums before and up to its end. A new positive token joins to the nearest earlier candidate that begins lower, if
    that one's end is lower than the token's too; then again, with the joined candidate.
    """
    total = np.concatenate(([0.0], np.cumsum(weights, dtype=np.float64)))
    lows: list[float] = []
    highs: list[float] = []
    spans: list[tuple[int, int]] = []
    nearest: list[int] = []  # for each candidate, the last one before it that begins lower
    for k in np.nonzero(weights > 0)[0].tolist():
        low, high, first = float(total[k]), float(total[k + 1]), k
        j = len(lows) - 1
        while True:
            while j >= 0 and lows[j] >= low:
                j = nearest[j]
            if j < 0 or highs[j] >= high:
                break
            low, first = lows[j], spans[j][0]
            below = nearest[j]
            del lows[j:], highs[j:], spans[j:], nearest[j:]
            j = below
        lows.append(low)
        highs.append(high)
        spans.append((first, k + 1))
        nearest.append(j)
    return [(a, b, h - low) for (a, b), low, h in zip(spans, lows, highs)]


#: Part of the prior that all buckets have alike; the rest follows their numbers in all documents.
FLAT = 0.5


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float, shrink: float, drift: float) -> np.ndarray:
    """Weights of the buckets from the numbers of toxic and clean documents that hold them."""
    both = toxic + clean
    alpha = FLAT + prior * both / max(both.sum(), 1.0)
    n1, n0 = toxic.sum() + prior, clean.sum() + prior
    out = np.full(len(both), -drift)
    seen = both > 0
    y1, y0 = toxic[seen] + alpha[seen], clean[seen] + alpha[seen]
    delta = np.log(y1 / (n1 - y1)) - np.log(y0 / (n0 - y0))
    error = np.sqrt(1 / y1 + 1 / y0)
    out[seen] += np.sign(delta) * np.maximum(0.0, np.abs(delta) - shrink * error)
    return out


def decay(weights: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share x exp(lambda x weight)) = 1; 1 where there is none, as with no positive weight."""
    use = share > 0
    w, p = weights[use], share[use] / share[use].sum() if use.any() else share[use]
    if not len(w) or w.max() <= 0 or (w * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * w, 700))).sum())
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return (low + high) / 2 or 1.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    decay: float
    scale: float  # K
    curve: tuple[float, ...]  # logistic: constant, best surprise, sum of surprises, log of length


def _facts(weights: np.ndarray, decay_: float, scale: float) -> tuple[float, float, float]:
    """Surprise of the best segment, log of the sum of surprises of all, log of the number of tokens."""
    n = len(weights)
    if not n:
        return 0.0, 0.0, 0.0
    base = math.log(max(scale * n, 1e-9))
    surprises = [x for _, _, s in segments(weights) if (x := decay_ * s - base) > 0]
    return min(max(surprises, default=0.0), 50.0), math.log1p(sum(surprises)), math.log1p(n)


def _score(facts: tuple[float, ...], curve: tuple[float, ...]) -> float:
    z = curve[0] + sum(a * b for a, b in zip(curve[1:], facts))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        pull = ridge * np.r_[0.0, beta[1:]]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]) + 1e-9, x.T @ (y - p) - pull)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    hold_mod: int = 4,
    hold_rest: int = 2,
    sample: int = 50_000,
    prior: float = 500.0,
    shrink: float = 1.5,
    drift: float = 0.8,
    seed: int = 29,
) -> Model:
    """Fit on at most ``sample`` labelled rows, which bounds what is broadcast; counts come back in a fixed number of buckets.

    Without labelled rows, or with one class only, every text gets the (smoothed) share of label 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = labelled(labels, label, hold_mod, hold_rest, sample, seed)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(2)).cast("int").alias("fold")
    # At most ``sample`` rows of two numbers: the broadcast is of known size, and texts are not shuffled.
    texts = text_and_id(docs).join(F.broadcast(cut(train)), "doc_id").select("doc_id", "text", "y", fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Buckets(), np.zeros((4, BUCKETS + 1), np.int64)  # the last column: documents
        for b in batches:
            for t, y, f in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                row = held[int(y) * 2 + f]
                row[np.unique(token_buckets(t.as_py(), known))] += 1
                row[BUCKETS] += 1
        kind, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(at, pa.int64()), pa.array(held[kind, at])], names=["kind", "bucket", "n"])

    summed = texts.mapInArrow(count, "kind long, bucket long, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow().to_pandas()
    table = np.zeros((4, BUCKETS + 1))
    table[found["kind"], found["bucket"]] = found["n"]
    clean, toxic = table[:2], table[2:]
    n0, n1 = clean[:, BUCKETS].sum(), toxic[:, BUCKETS].sum()
    constant = (math.log((n1 + 1) / (n0 + 1)), 0.0, 0.0, 0.0)
    if not n0 or not n1:
        return Model(np.full(BUCKETS, -drift, np.float32), 1.0, 1.0, constant)

    def weigh(folds: list[int]) -> np.ndarray:
        return log_odds(toxic[folds, :BUCKETS].sum(0), clean[folds, :BUCKETS].sum(0), prior, shrink, drift)

    share = clean[:, :BUCKETS].sum(0)
    weights = weigh([0, 1])
    rate = decay(weights, share)
    other = spark.sparkContext.broadcast([weigh([1]), weigh([0])])  # two arrays of fixed size

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for b in batches:
            rows = []
            for i, t, y, f in zip(*[b.column(k).to_pylist() for k in (0, 1, 2, 3)]):
                w = other.value[f][token_buckets(t, known)]
                top = max((s for _, _, s in segments(w)), default=0.0)
                rows.append((i, y, len(w), top, *[_facts(w, rate, k)[j] for k in _GRID for j in (0, 1)]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)

    names = ["doc_id", "y", "n", "top"] + [f"f{k}_{j}" for k in range(len(_GRID)) for j in (0, 1)]
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.float64()] + [pa.float64()] * (2 * len(_GRID))
    schema = ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in zip(names, kinds))
    held = texts.mapInArrow(best, schema).toArrow().to_pandas().sort_values("doc_id")
    quiet = held[(held["y"] == 0) & (held["n"] > 0)]
    scale = len(quiet) / max(float((quiet["n"] * np.exp(-rate * quiet["top"])).sum()), 1e-9) if len(quiet) else 1.0
    near = int(np.argmin([abs(math.log(k / scale)) for k in _GRID]))
    x = np.column_stack([held[f"f{near}_0"], held[f"f{near}_1"], np.log1p(held["n"])])
    curve = _logistic(x, held["y"].to_numpy())
    return Model(weights.astype(np.float32), rate, _GRID[near], tuple(curve.tolist()))


#: Values that K is rounded to, so that its estimate and the curve need one pass over the sample.
_GRID = tuple(10.0 ** (-k / 2) for k in range(9))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Model | None = None, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages): one row per row of ``docs``; passages is the number of significant ones."""
    model = model or fit(docs, labels, **how)
    mod, rest = how.get("hold_mod", 4), how.get("hold_rest", 2)
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.decay, model.scale, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rate, scale, curve = held.value
        known = _Buckets()
        for b in batches:
            scores, passages = [], []
            for t in b.column(1):
                w = weights[token_buckets(t.as_py(), known)]
                scores.append(_score(_facts(w, rate, scale), curve))
                passages.append(len(_significant(w, rate, scale, LEVEL)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.int32())], names=["doc_id", "score", "passages"]
            )

    scored = text_and_id(docs).mapInArrow(run, "doc_id long, score double, passages int")
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )


#: Expected number of such segments in a clean text of the same length below which a segment is significant.
LEVEL = 0.05


def _significant(w: np.ndarray, rate: float, scale: float, level: float) -> list[tuple[int, int, float, float]]:
    found = []
    for a, b, s in segments(w) if len(w) else []:
        expected = scale * len(w) * math.exp(-min(rate * s, 700))
        if expected <= level:
            found.append((a, b, s, expected))
    return found


def passages(docs: DataFrame, model: Model, level: float = LEVEL) -> DataFrame:
    """(doc_id, start, end, score, expected, passage) of every significant passage; start and end count characters."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.decay, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rate, scale = held.value
        known = _Buckets()
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                found = _significant(weights[token_buckets(text, known)], rate, scale, level)
                if found:
                    spans = [m.span() for m in _TOKEN.finditer(text)]
                    for a, z, s, e in found:
                        start, end = spans[a][0], spans[z - 1][1]
                        rows.append((i, start, end, s, e, text[start:end]))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "end", "score", "expected", "passage"])

    return text_and_id(docs).mapInArrow(run, "doc_id long, start long, end long, score double, expected double, passage string")
