"""Near-duplicate texts: an exact Jaccard similarity of word shingles, on candidates of a SimHash ring and then of banded minima.

Two texts are linked if their sets of shingles (``words`` words in a row, A-Z in lower case; a shorter text is one shingle) have a
Jaccard similarity of ``similar`` at least. Each set has a SimHash fingerprint, and the pigeonring (``simhash_ring``) proposes those that differ in
at most two bits; what is linked there goes on as one component. At 0.8 the bits differ by 3 to 11, and a budget as wide as that is shared by many
unrelated texts, so the ring alone would lose most links: the further candidates come from keys of several minima each (``LEVELS``): two texts of similarity s share
none of ``bands`` keys of ``rows`` minima with a chance of (1 - s^rows)^bands, 2e-4 at 0.8 on the first level and less above.

What is wanted are the groups that links connect, not all links. Texts of equal sets are one node. Under each key all nodes meet
its most central node first, that of the most and largest keys; in a group of copies most keys have the same one, so a group costs about
its size. Keys whose nodes are then all in one component are done. In the others, if few nodes share them, every two of different
components meet, in the task of the key, and only those go on whose minima agree about as often as a link's would. Nodes of
crowded keys go to the next level, where keys have more minima and so fewer nodes; more keys make up for it. What is still crowded on the last
level meets pair by pair. Every candidate is checked on the whole sets, which are written once, for the nodes that share a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions.graph import components
from mendline.functions.scale import parts
from mendline.llm import simhash_ring
from mendline.llm.common import cut, cut_with, few, narrow, returning, small_batches, without_rows

WORDS, SIMILAR = 5, 0.8
#: (rows, bands) of each level; at 0.8 two texts miss each other with a chance of 2e-4, 3e-3 and 1e-2.
LEVELS = ((7, 36), (12, 80), (20, 400))
#: Nodes of a key up to which every two of different components meet at once.
CROWD = 32
#: Minima kept as a byte each, to drop candidates whose agreement is far from a link's; nodes on a side of a block of pairs.
BYTES, BLOCK_NODES = 252, 2500
_BLOCK = 512
_SALT = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Hashes of words met so far; words are few and come often."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int = WORDS, known: _Words | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; texts without words have the one of the empty shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], dtype=np.uint64)
    known = _Words() if known is None else known
    each = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(found) - words + 1
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h = (h ^ each[i : i + n]) * _SALT
        h ^= h >> np.uint64(29)
    return np.unique(h)


class Minima:
    """The keys of one level: minima of ``rows`` orders folded into one number, for each of ``bands``."""

    def __init__(self, level: int):
        self.rows, self.bands = LEVELS[level]
        drawn = np.random.Generator(np.random.PCG64(42 + level))
        size = self.rows * self.bands
        self.times = drawn.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = drawn.integers(0, 1 << 32, size, dtype=np.uint32)
        self.fold = drawn.integers(0, 1 << 63, (self.bands, self.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        least = np.full(len(self.times), np.uint32((1 << 32) - 1))
        step = max(1, _BLOCK * 256 // len(self.times))
        for i in range(0, len(low), step):
            np.minimum(least, (low[i : i + step, None] * self.times + self.plus).min(0), out=least)
        return least

    def keys(self, least: np.ndarray) -> np.ndarray:
        """A band's number is part of its key."""
        folded = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.fold).sum(1, dtype=np.uint64)
        folded ^= folded >> np.uint64(32)
        return folded * self.fold[:, 0]


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text); h tells texts apart."""
    d = narrow(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("h"), text.alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts or [np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(flat))


def prints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, h, node, fp, keys) of every row: the set of shingles, its fingerprint and its keys on the first level."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known = Minima(0), _Words()
        for b in batches:
            sets = [shingles(t.as_py(), words, known) for t in b.column(2)]
            keys = _lists([first.keys(first.of(s)) for s in sets])
            fps = np.array([simhash_ring.fingerprint_of(s) for s in sets], np.uint64).view(np.int64)
            columns = [b.column(0), b.column(1), pa.array([_node(s) for s in sets], pa.int64()), pa.array(fps), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "node", "fp", "keys"])

    return _rows(docs).mapInArrow(returning(run), "doc_id long, h long, node long, fp long, keys array<long>")


def ring_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of ``prints`` whose fingerprints the ring connects. The nodes of one fingerprint meet its smallest one."""
    nodes = rows.select("fp", "node").distinct()
    each = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    own = lambda end: each.select(F.col("fp").alias(f"{end}_fp"), F.col("least").alias(end)).hint("shuffle_hash")
    near = simhash_ring.links(each).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(own("a"), "a_fp").join(own("b"), "b_fp")
    same = nodes.join(each.filter("least < most").hint("shuffle_hash"), "fp").filter("node <> least")
    pairs = near.select("a", "b").unionByName(same.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> tuple[DataFrame, int]:
    """(node, n, sig, hashes) of the nodes of ``needed`` (node, h), and their number: the set, its size and its first minima, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known = Minima(0), _Words()
        for b in batches:
            sets = [shingles(t.as_py(), words, known) for t in b.column(0)]
            sigs = [first.of(s)[:BYTES].astype(np.uint8).tobytes() for s in sets]
            columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), _lists(sets)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sig", "hashes"])

    rows = _rows(docs).select("h", "text")
    # Few texts: the scan drops the others. Many: texts and list meet by a shuffle.
    some = rows.join(few(needed.select("h")), "h", "left_semi").dropDuplicates(["h"])
    return _gathered(some.select("text").mapInArrow(returning(run), "node long, n int, sig binary, hashes array<long>"), 2000)


def _gathered(df: DataFrame, rows: int = 10_000) -> tuple[DataFrame, int]:
    """``df`` written, in as few partitions as its rows need, and their number: each task of a later shuffle writes files."""
    done, seen = cut_with(df, n=F.count(F.lit(1)))
    return done.coalesce(parts(seen["n"], rows)), seen["n"]


def _shared(entries: DataFrame) -> tuple[DataFrame, int]:
    """The distinct (key, node) of keys with several nodes, written, and their number."""
    several = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    return _gathered(entries.join(several, "key").distinct())


def _next_keys(sets: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(level)
        for b in batches:
            lists = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([minima.keys(minima.of(s)) for s in lists])], names=["node", "keys"])

    own = sets.join(nodes, "node", "left_semi").select("node", "hashes")
    return own.mapInArrow(returning(run), "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def _open(rooted: DataFrame) -> DataFrame:
    """Of rows (key, node, root): those of keys with several roots, and m, the nodes of the key."""
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    return _gathered(rooted.select("key", "node", "root").join(keys.select("key", "m"), "key"))[0]


def _with_heads(open_: DataFrame) -> DataFrame:
    """(a, b, a_root, b_root, degree): under each key, its most central node and each node of another component; degree is that of ``a``."""
    degree = open_.groupBy("node").agg(F.sum("m").alias("degree"))
    met = open_.join(degree, "node")
    heads = met.groupBy("key").agg(F.max(F.struct("degree", "node", "root")).alias("head"))
    pairs = open_.join(heads, "key").filter(F.col("root") != F.col("head.root"))
    return pairs.select(
        F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.root").alias("a_root"), F.col("root").alias("b_root"), F.col("head.degree").alias("degree")
    ).distinct()


def _meetings(similar: float):
    """For rows (key, node, root, n, sig) sorted by key: the pairs of a key that may be linked, of different components."""
    least = similar - 4.5 * math.sqrt(similar * (1 - similar) / BYTES)

    def solve(node, root, n, sig) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for i in range(len(node) - 1):
            rest = slice(i + 1, None)
            fits = (root[rest] != root[i]) & (np.minimum(n[rest], n[i]) >= similar * np.maximum(n[rest], n[i]))
            j = np.nonzero(fits)[0] + i + 1
            j = j[(sig[j] == sig[i]).mean(1) >= least]
            out.append((np.full(len(j), node[i]), node[j]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def close():
            node, root, n, sig = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(node, root, n, sig)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, root, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BYTES)
            starts = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)]))
            for s, e in zip(starts[:-1], starts[1:]):
                if held and key[s] != current:
                    yield close()
                    held = []
                current = key[s]
                held.append((node[s:e], root[s:e], n[s:e], sig[s:e]))
        if held:
            yield close()

    return run


def _meet(open_: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    rows = open_.join(sets.select("node", "n", "sig"), "node").select("key", "node", "root", "n", "sig")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(returning(_meetings(similar)), "a long, b long").distinct()


def _compared(similar: float):
    """For rows (block, a, b, hashes) sorted by block, sets (without b) before pairs: the pairs whose sets are as similar as that."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < similar * max(len(x), len(y)):
            return False
        same = len(x) + len(y) - len(np.union1d(x, y))
        return same >= similar * (len(x) + len(y) - same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, {}
        for batch in batches:
            left, right = [], []
            lists = batch.column(3)
            for i, (block, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if block != current:
                    current, sets = block, {}
                if b is None:
                    sets[a] = lists[i].values.to_numpy(zero_copy_only=False)
                elif alike(sets[a], sets[b]):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _checked(pairs: DataFrame, sets: DataFrame, n_sets: int, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as that.

    Pairs are dealt out in blocks by the hashes of both ends, about ``BLOCK_NODES`` nodes to a side, and a set goes to a block once, however
    many of its pairs lie there.
    """
    sides = max(8, -(-n_sets // BLOCK_NODES))
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    dealt = pairs.select((side("a") * sides + side("b")).alias("block"), "a", "b")
    needed = dealt.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = needed.join(sets.select("node", "hashes"), "node").select("block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    rows = sent.unionByName(dealt.withColumn("hashes", F.lit(None).cast("array<long>")))
    ordered = rows.repartition("block").sortWithinPartitions("block", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(returning(_compared(similar)), "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR, crowd: int = CROWD) -> DataFrame:
    """(doc_id, h, root) of every row: root is that of all rows reachable over links. Null texts count as empty."""
    rows = cut(prints(docs, words))
    sets = n_sets = joined = None
    links: list[DataFrame] = []

    def linked(pairs: DataFrame) -> tuple[DataFrame, int]:
        found, n = _gathered(_checked(pairs.select("a", "b"), sets, n_sets, similar))
        if n:
            links.append(found)
        return found, n

    ring, n_ring = _gathered(ring_pairs(rows))
    entries = rows.select(F.explode("keys").alias("key"), "node")
    for level in range(len(LEVELS)):
        shared, n = _shared(entries)
        if sets is None and (n or n_ring):
            texts = rows.groupBy("node").agg(F.min("h").alias("h"))
            needed = shared.select("node").unionByName(ring.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
            sets, n_sets = _sets(docs, _gathered(texts.join(needed, "node"))[0], words)
            if n_ring and linked(ring)[1]:
                joined = components(_union(links), "a", "b")
        if not n:
            break
        rooted = shared.withColumn("root", F.col("node"))
        if joined is not None:
            rooted = shared.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
        open_ = _open(rooted)
        pairs, n = _gathered(_with_heads(open_))
        found, n = linked(pairs)
        if n:  # whoever is linked to a head goes under its root, that of the most central one
            under = found.join(pairs, ["a", "b"]).groupBy(F.col("b_root").alias("root")).agg(F.max_by("a_root", "degree").alias("to"))
            open_ = _open(open_.join(under, "root", "left").select("key", "node", F.coalesce("to", "root").alias("root")))
        last = level == len(LEVELS) - 1
        near = open_ if last else open_.filter(F.col("m") <= crowd)
        if not near.isEmpty():
            linked(_gathered(_meet(near, sets, similar))[0])
        crowded, n = _gathered(open_.filter(F.col("m") > crowd).select("node").distinct())
        if links:
            joined = components(_union(links), "a", "b")
        if last or not n:
            break
        entries = _next_keys(sets, crowded, level + 1)
    if joined is None:
        return rows.select("doc_id", "h", F.col("node").alias("root"))
    return rows.select("doc_id", "h", "node").join(joined, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("root"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def keep_one(docs: DataFrame, words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, null ids last, equal ids by their texts.

    Rows are told apart by id and text: a text of its own stays, whatever other rows bear its id, and of repeated rows one stays. Null texts
    count as empty, and all texts without words are one group. No rows give no rows.
    """
    found = cut(groups(docs, words, similar))
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = found.join(best, "root").withColumn("stays", F.col("h").eqNullSafe(F.col("best.h")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    return without_rows(docs, met.select("doc_id", "h", "stays"), text_key(docs["text"]))
