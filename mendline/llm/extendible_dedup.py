"""Exact de-duplication through an extendible-hash index.

1. Every text gets a 64-bit key of its normalised bytes (A-Z lower-cased). A bitmap of fixed size marks the keys that occur more
   than once; texts of other keys are alone and never move.
2. Each scan task chains its own texts of marked keys: a text equal in all bytes to one seen before in the task joins that entry,
   so a third of all rows being copies yields one entry per task, not one per row.
3. The directory: entries are counted by key prefix, and a bucket above its capacity is split on the next bit of the key; where
   a split goes deeper than the directory, the directory doubles. A bucket is thus a range of keys. Equal keys cannot be
   split, and are chained in their bucket whatever their number.
4. Entries go to the owner task of their bucket, which walks them in key order, compares bytes along the chain of a key, and
   names the first equal entry. Only the chain of one key is held.

What is written lies in the shared checkpoint folder, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.llm.common import cut, small_batches, text_and_id, without, without_rows

#: Bits of the bitmap of repeated keys (1 MB) and of the prefix by which entries are counted; both fix what the driver holds.
MARK_BITS = 23
PREFIX_BITS = 16
_HELD_BYTES = 64 << 20


def _normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only


def _key(body: bytes) -> int:
    k = xxhash.xxh3_64_intdigest(body)
    return k - (1 << 64) if k >> 63 else k


@dataclass(frozen=True)
class Directory:
    """``slots[prefix of global_depth bits]`` is the bucket of a key; ``local_depth[bucket]`` its bits in common."""

    global_depth: int
    slots: np.ndarray
    local_depth: np.ndarray

    @staticmethod
    def grow(counts: np.ndarray, capacity: int) -> Directory:
        """Split buckets until each holds at most ``capacity`` entries or its prefix is used up. ``counts``: by full prefix."""
        most = int(np.log2(len(counts)))
        before = np.concatenate(([0], np.cumsum(counts)))
        slots, depth, global_depth = [0], [0], 0
        pending = [(0, 0, 0)]  # bucket, its prefix, its local depth
        while pending:
            bucket, prefix, local = pending.pop()
            span = len(counts) >> local
            if local == most or before[(prefix + 1) * span] - before[prefix * span] <= capacity:
                continue
            if local == global_depth:
                slots = [b for b in slots for _ in (0, 1)]  # the directory doubles
                global_depth += 1
            new = len(depth)
            depth[bucket] = local + 1
            depth.append(local + 1)
            width = 1 << (global_depth - local - 1)
            at = (2 * prefix + 1) * width
            slots[at : at + width] = [new] * width
            pending += [(bucket, 2 * prefix, local + 1), (new, 2 * prefix + 1, local + 1)]
        return Directory(global_depth, np.array(slots, np.int64), np.array(depth, np.int64))

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return _bucket(self.slots, keys)


def _bucket(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
    depth = len(slots).bit_length() - 1
    return slots[(keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64)] if depth else np.zeros(len(keys), np.int64)


def _keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(_normal(t.as_py())) for t in b.column(0)], pa.int64())], names=["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _marks(keys: DataFrame) -> np.ndarray:
    """Bitmap of the keys that occur more than once, 2**MARK_BITS bits whatever the corpus; a chance hit only means needless comparing."""
    slot = F.col("key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    repeated = keys.groupBy("key").count().filter("count > 1")
    words = repeated.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def _task_chains(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """Every row with its place, key and digest; rows of marked keys with their entry, and the first of an entry with its bytes."""
    held_marks = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held_marks.value
        row = TaskContext.get().partitionId() << 40
        chains: dict[int, list[tuple[bytes, int, str]]] = {}
        held = 0
        for b in batches:
            out: list[tuple] = []
            for text in b.column(1):
                body = _normal(text.as_py())
                key = _key(body)
                slot = key & ((1 << MARK_BITS) - 1)
                if not int(bits[slot >> 6]) >> (slot & 63) & 1:
                    out.append((row, key, None, hashlib.sha256(body).hexdigest(), None))
                else:
                    chain = chains.setdefault(key, [])
                    known = next(((e, d) for x, e, d in chain if x == body), None)
                    if known:
                        out.append((row, key, known[0], known[1], None))
                    else:
                        digest = hashlib.sha256(body).hexdigest()
                        chain.append((body, row, digest))
                        held += len(body) + 200
                        out.append((row, key, row, digest, body))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
                names=["doc_id", "row", "key", "entry", "digest", "body"],
            )
            if held > _HELD_BYTES:  # later copies start a new entry, which its owner joins to this one
                chains, held = {}, 0

    return docs.select("doc_id", "text").mapInArrow(
        (lambda batches: run(b for b in batches if b.num_rows)), "doc_id long, row long, key long, entry long, digest string, body binary"
    )


def _directory(entries: DataFrame, capacity: int) -> Directory:
    prefix = F.shiftrightunsigned("key", 64 - PREFIX_BITS).cast("int").alias("prefix")
    found = entries.groupBy(prefix).count().toPandas()  # 2**PREFIX_BITS rows at most
    counts = np.zeros(1 << PREFIX_BITS, np.int64)
    counts[found["prefix"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    return Directory.grow(counts, capacity)


def _owned(entries: DataFrame, directory: Directory) -> DataFrame:
    """(bucket, key, entry, root): the first entry of equal bytes, found by the owner of the bucket."""
    held = entries.sparkSession.sparkContext.broadcast(directory.slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(held.value, keys)), *b.columns], names=["bucket", "key", "entry", "body"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chain = None, []
        for b in batches:
            roots = []
            for key, entry, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if key != current:
                    current, chain = key, []
                body = body.as_py()
                root = next((e for x, e in chain if x == body), None)
                if root is None:
                    chain.append((body, root := entry))
                roots.append(root)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(roots, pa.int64())], names=["bucket", "key", "entry", "root"])

    placed = entries.select("key", "entry", "body").mapInArrow(place, "bucket long, key long, entry long, body binary")
    owners = placed.repartition("bucket").sortWithinPartitions("bucket", "key", "entry")
    return owners.mapInArrow(own, "bucket long, key long, entry long, root long")


def exact_groups(docs: DataFrame, capacity: int = 1000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, bucket), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. keep_id is the largest doc_id of the group, null ids
    being smallest, and exactly one row of a group is kept, also where rows repeat. bucket: that of the index, null for texts alone.
    """
    small_batches(docs.sparkSession)
    texts = text_and_id(docs)
    marks = _marks(_keys(texts))
    rows = cut(_task_chains(texts, marks))
    entries = rows.filter("body is not null").select("key", "entry", "body")
    owned = cut(_owned(entries, _directory(entries, capacity)).select("entry", "root", "bucket"))
    chained = rows.filter("entry is not null").select("doc_id", "row", "entry", "digest")
    best = chained.groupBy("entry").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    groups = (
        best.join(owned, "entry").groupBy("root").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
    )
    of_entry = owned.join(groups, "root").select("entry", "bucket", "best", "group_size")
    many = chained.join(of_entry, "entry").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "bucket",
    )
    alone = rows.filter("entry is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.lit(None).cast("long").alias("bucket"),
    )
    return many.unionByName(alone)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER).cast("binary"), 256)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the largest doc_id.

    Null texts count as empty, and all empty texts are one group. Null ids are smallest. Of repeated rows one stays. No rows give no rows.
    """
    found = cut(exact_groups(docs).select("doc_id", F.col("text_sha256").alias("h"), F.col("kept").alias("stays")))
    ids = found.groupBy("doc_id").agg(F.max("stays").alias("some"), F.count(F.lit(1)).alias("n"))
    # Ids that name several rows, and rows without one, are told apart by their texts; where there are none, the id is enough.
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        return without(docs, ids.filter("not some"))
    return without_rows(docs, found, text_digest(docs["text"]))
