"""SimHash near-duplicates by pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most ``budget`` bits, then from some segment on
every chain of consecutive segments has at most (length x budget / segments) differing bits. With 3 segments and 2 bits that
means: an equal segment, at most one differing bit over it and the next one, at most two over all three. Candidates come from the
equal segment; the chain prunes them before the full Hamming check.

Buckets hold distinct fingerprints only, so copies cost nothing. A bucket above ``bucket_rows`` is divided by the next step of the
chain: its members meet again under the next segment with one bit masked, for every bit, which loses no link. A task returns
for each bucket a spanning set of links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.llm import graph
from mendline.llm.common import cut, small_batches, text_and_id

BITS = 64
#: Start and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUDGET = 2
_BLOCK = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint: bit set where more than half of the shingles' XXH64 (seed 42) have it set."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[words - 1 :] if len(found) >= words else ends[-1:]
    starts = starts[: len(ends)]
    n, votes = len(ends), np.zeros(BITS, np.int64)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    for i in range(0, n, _BLOCK):
        spans = zip(starts[i : i + _BLOCK].tolist(), ends[i : i + _BLOCK].tolist())
        h = np.array([digest(view[s:e], 42) for s, e in spans], dtype="<u8")
        votes += _votes(h)
    return _majority(votes, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of one or more 64-bit hashes of shingles, however those are cut."""
    return _majority(_votes(hashes), len(hashes))


def _majority(votes: np.ndarray, n: int) -> int:
    return int(np.bitwise_or.reduce(np.where(2 * votes > n, np.uint64(1) << np.arange(BITS, dtype=np.uint64), np.uint64(0))))


_LANE = np.uint64(0x0101010101010101)


def _votes(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Eight bit counters ride in the bytes of one word, up to 255 hashes at a time."""
    out = np.zeros(BITS, np.int64)
    cuts = np.arange(0, len(h), 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANE, cuts)
        out[bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed long. One row per row of ``docs``; null and empty texts have 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return text_and_id(docs).mapInArrow(run, "doc_id long, fp long")


def _chain_pairs(fp: np.ndarray, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows among rows sorted by ``key``; ``order`` is the segment that the key makes equal."""
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    left = np.repeat(first + count, count) - np.arange(len(key)) - 1  # rows of the same key that follow
    masks = np.array([((1 << w) - 1) << s for s, w in SEGMENTS], dtype=np.uint64)
    got_a, got_b = [], []
    at = np.nonzero(left > 0)[0]
    step = 1
    while len(at):
        x = fp[at] ^ fp[at + step]
        start = order[at]
        next_two = np.bitwise_count(x & (masks[start] | masks[(start + 1) % 3]))
        fits = next_two <= 2 * BUDGET // 3  # the chain of two
        a, x = at[fits], x[fits]
        linked = np.bitwise_count(x) <= BUDGET
        got_a.append(a[linked])
        got_b.append(a[linked] + step)
        step += 1
        at = at[left[at] >= step]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(got_a) if got_a else empty, np.concatenate(got_b) if got_b else empty)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row linked with it), for the rows that a pair touches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, seg, fp) sorted by key; whole keys are handled together, across batches."""

    def solve(parts: list[np.ndarray]) -> pa.RecordBatch:
        t = np.concatenate(parts, axis=1)
        fp = t[2].view(np.uint64)
        a, b = _chain_pairs(fp, t[0], t[1])
        a, b = _spanning(a, b, len(fp))
        return pa.RecordBatch.from_arrays([pa.array(t[2][a]), pa.array(t[2][b])], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        last = int(np.searchsorted(t[0], t[0, -1]))  # where the last key begins
        if held and held[0][0, 0] != t[0, -1] or last:
            yield solve([*held, t[:, :last]])
            held = []
        held.append(t[:, last:])
    if held:
        yield solve(held)


def _segment(i: int):
    start, width = SEGMENTS[i]
    return F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (longs) that differ in 1 or 2 bits, enough of them to connect all that are linked."""
    each = prints.select("fp").distinct()
    entries = each.select(
        F.posexplode(F.array(*[_segment(i) for i in range(3)])).alias("seg", "part"), "fp"
    ).select(F.xxhash64("seg", "part").alias("key"), "seg", "part", "fp")
    # Keys of large buckets: at most one per bucket_rows entries.
    entries = cut(entries)
    large = cut(entries.groupBy("key").count().filter(F.col("count") > bucket_rows).select("key"))
    if large.isEmpty():
        return _linked(entries)
    following = F.element_at(F.array(*[_segment((i + 1) % 3) for i in range(3)]), F.col("seg") + 1)
    masks = F.transform(
        F.sequence(F.lit(0), F.lit(max(w for _, w in SEGMENTS) - 1)),
        lambda k: F.xxhash64("key", k, following.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), k)))),
    )
    big = entries.join(large, "key").select(F.explode(masks).alias("key"), "seg", "fp")
    whole = entries.join(large, "key", "left_anti").select("key", "seg", "fp")
    return _linked(whole.unionByName(big))


def _linked(entries: DataFrame) -> DataFrame:
    ordered = entries.select("key", F.col("seg").cast("long").alias("seg"), "fp").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_link_sorted, "a long, b long")


def hex_of(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the own one included. Texts without words link like any other
    (fingerprint zero). Rows that share a doc_id are one document; a null doc_id gives a null component unless linked.
    """
    prints = cut(fingerprints(docs))
    joined = graph.components(links(prints, bucket_rows))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    group = least.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("root"), "least"
    )
    roots = group.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = group.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
