"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, to which it comes
nearest. A table joins FUNCTIONS such hashes; multiprobe adds the buckets that second-nearest axes give, those of the smallest
loss first, so a vector is in PROBES buckets of each of TABLES tables. For two vectors of cosine 0.95 in 64 dimensions this
misses fewer than one pair in a thousand. Candidates share a bucket; every one is verified by its cosine in double precision.

Equal vectors are hashed once. Vectors travel only to buckets that others share. A large bucket is divided into blocks, and
every two of its blocks meet in a group of their own. A pair is counted in the first bucket that it shares, so that counts need no
list of pairs; groups return counts and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from mendline.llm import graph
from mendline.llm.common import cut, narrow

TABLES, FUNCTIONS, PROBES = 6, 3, 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(x: np.ndarray, seed: int) -> np.ndarray:
    """(rows, TABLES x PROBES) keys of the rows of ``x``, different for different dimensions."""
    rows, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((rows, width))
    padded[:, :dim] = x
    out = []
    for table in range(TABLES):
        axes, losses = [], []
        for f in range(FUNCTIONS):
            signs = np.random.default_rng([seed, dim, table, f]).choice([-1.0, 1.0], (3, width))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :2]
            at = np.take_along_axis(y, best, 1)
            axes.append(2 * best + (at < 0))
            losses.append(np.abs(at[:, 0]) - np.abs(at[:, 1]))
        # All choices of nearest or second axis, in order of loss.
        choices = (np.arange(1 << FUNCTIONS)[:, None] >> np.arange(FUNCTIONS)) & 1
        loss = np.stack(losses, 1) @ choices.T
        order = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        key = np.full((rows, PROBES), table + 1, np.int64)
        for f in range(FUNCTIONS):
            key = key * (2 * width) + np.take_along_axis(axes[f], choices[order, f], 1)
        out.append(key * 8191 + dim)
    return np.concatenate(out, axis=1)


def _unit(v: bytes, kind: str) -> np.ndarray:
    x = np.frombuffer(v, kind).astype(np.float64)
    if kind == "f8":
        x = x / np.abs(x).max()  # squares of large or small components stay finite
    return x / np.linalg.norm(x)


def _kind(vectors: DataFrame) -> str:
    """Width in which components are held: that of the column, 32 bits for floats and 64 for all other numbers."""
    column = next((f.dataType for f in vectors.schema if f.name.lower() == "embedding"), None)
    return "f4" if isinstance(getattr(column, "elementType", None), FloatType) else "f8"


def _rows(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, v): v packs the components of a usable vector, else null."""
    spark_type = "array<float>" if kind == "f4" else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1):
                values = x.values if x.is_valid else None
                if values is None or not len(values) or values.null_count:
                    out.append(None)
                    continue
                a = values.to_numpy(zero_copy_only=False).astype(kind)
                out.append((a + a.dtype.type(0)).tobytes() if np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    d = narrow(vectors, "vec_id", "embedding")
    typed = d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(spark_type).alias("embedding"))
    return typed.mapInArrow(run, "vec_id long, v binary")


def _hashed(distinct: DataFrame, seed: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            keys = np.zeros((len(raw), TABLES * PROBES), np.int64)
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                keys[at] = buckets(np.stack([_unit(raw[i], kind) for i in at]), seed)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["uid", "n", "v", "keys"])

    return distinct.select("uid", "n", "v").mapInArrow(run, "uid long, n long, v binary, keys array<long>")


def _verify(uid: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, key: int, side: np.ndarray, low: float):
    """Counts and spanning links of one group; ``side`` tells the blocks apart, if the group is of two."""
    linked = x @ x.T >= low
    np.fill_diagonal(linked, False)
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    if not linked.any():
        return uid[:0], n[:0], uid[:0], uid[:0]
    # Pairs that share a smaller key are counted there.
    rows, cols = np.nonzero(keys < key)
    values, place = np.unique(keys[rows, cols], return_inverse=True)
    met = np.zeros((len(uid), len(values)), np.float32)
    met[rows, place] = 1
    met = met[:, met.sum(0) > 1]
    first = linked & (met @ met.T == 0) if met.shape[1] else linked
    part = first @ n
    label = np.arange(len(uid))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(uid)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    least = np.full(len(uid), np.iinfo(np.int64).max)
    np.minimum.at(least, label, uid)
    root = least[label]
    got, moved = part > 0, root != uid
    return uid[got], part[got], uid[moved], root[moved]


def _groups(members: DataFrame, low: float, kind: str) -> DataFrame:
    """Rows (uid, part, a, b): counts of a vector in one group, or a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list) -> pa.RecordBatch:
            found = _verify(
                np.array([r[3] for r in rows], np.int64),
                np.array([r[4] for r in rows], np.int64),
                np.stack([_unit(r[5], kind) for r in rows]),
                np.array([r[6] for r in rows], np.int64),
                rows[0][0],
                np.array([r[1] != r[2] and r[7] == r[2] for r in rows]),
                low,
            )
            a, p, u, r = found
            none = lambda k: pa.nulls(k, pa.int64())
            columns = [(pa.array(a), none(len(u))), (pa.array(p.astype(np.int64)), none(len(u))), (none(len(a)), pa.array(u)), (none(len(a)), pa.array(r))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["uid", "part", "a", "b"])

        held, current = [], None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:3] != current:
                    if len(held) > 1:
                        yield solve(held)
                    held, current = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield solve(held)

    ordered = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "uid")
    return ordered.select("key", "i", "j", "uid", "n", "v", "keys", "block").mapInArrow(run, "uid long, part long, a long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, block_rows: int = 256, seed: int = 31) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    n_links counts the other rows linked directly, equal vectors among them; component_id is the smallest vec_id reachable. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and neither do vectors of different lengths. Cosines are taken in
    double precision of the components as the column holds them.
    """
    kind = _kind(vectors)
    rows = cut(_rows(vectors, kind)).withColumn("row", F.monotonically_increasing_id())
    usable = rows.filter("v is not null")
    distinct = usable.groupBy("v").agg(F.min("row").alias("uid"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = cut(distinct)
    hashed = cut(_hashed(distinct, seed, kind))
    entries = hashed.select("uid", F.explode(F.array_distinct("keys")).alias("key"))
    shared = entries.groupBy("key").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / block_rows).cast("int")
    joint = entries.join(shared, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("uid"), F.col("blocks").cast("long")).cast("int")
    spread = joint.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = spread.select("uid", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = cut(_groups(grouped.join(hashed, "uid"), cosine, kind))
    counts = found.filter("uid is not null").groupBy("uid").agg(F.sum("part").alias("linked"))
    joined = graph.components(found.filter("a is not null").select("a", "b"))
    facts = (
        distinct.join(counts, "uid", "left")
        .join(joined.withColumnRenamed("node", "uid"), "uid", "left")
        .select("uid", "v", "least", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "uid").alias("root"))
    )
    roots = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    known = facts.join(roots, "root").select("v", "n_links", "component_id")
    linked = usable.join(known, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
