"""Ranked lexical search by Block-Max MaxScore over sharded, block-compressed postings.

1. Each scan task turns its documents into shards: documents in the order of their ids, and for every term of the query set a list of
   postings in blocks of 128, gaps and frequencies in as few bytes as the list allows. A block keeps its last document and the
   maximum of its postings' shares of a score, a list the maximum of all.
2. Per query and shard the lists are ordered by their bounds. Lists whose bounds together cannot lift a document over the tenth score are
   not essential: only the others give candidates. A candidate is then looked up in the remaining lists from the largest bound
   down, and the maximum of the block it would lie in rejects it before that block is decompressed.
3. The ten best of every shard are merged in two steps, by groups of shards and over all.

All scores are exact integers. A shard is bounded by its postings, so a task holds one shard whatever the corpus; queries go to the
tasks in blocks of a bounded number of terms. The index of a block of queries is written to the shared folder once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.functions.scale import global_rank
from mendline.llm.common import cut, narrow, small_batches, text_and_id

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: In UTF-8 all bytes of signs beyond ASCII are 0x80 or more, so that terms can be cut from bytes.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 128
#: Postings of a shard, terms of a block of queries, documents of the first and of the largest stretch that is searched at once.
SHARD_POSTINGS, QUERY_TERMS = 1 << 21, 100_000
_FIRST, _STRETCH = 256, 4096
_INDEX = "shard long, term int, df long, gaps binary, counts binary, gap_width int, count_width int, last binary, most binary"


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_list(text: Column) -> Column:
    """The terms of a column as an array of strings; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _narrowed(x: np.ndarray) -> tuple[bytes, int]:
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return x.astype(kind).tobytes(), kind.itemsize


def _totals(texts: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for b in batches:
            sizes = [len(terms(t.as_py())) for t in b.column(0)]
            docs, total = docs + sum(map(bool, sizes)), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], names=["docs", "total"])

    found = texts.select("text").mapInArrow(run, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


@dataclass
class _Open:
    """A shard that still takes documents."""

    ids: list
    m: list[int]
    words: list[np.ndarray]
    owners: list[np.ndarray]
    tfs: list[np.ndarray]
    size: int = 0

    def rows(self, shard: int) -> pa.RecordBatch:
        """The lists of the shard by term, then one row of its documents: ids, m and which ids are null."""
        null = np.array([i is None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        order = np.lexsort((ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = np.array(self.m, np.int64)
        term, tf = np.concatenate(self.words), np.concatenate(self.tfs)
        doc = place[np.concatenate(self.owners)]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        share = _share(tf, m[order][doc])
        out: dict[str, list] = {k.split()[0]: [] for k in _INDEX.split(", ")}
        starts = np.concatenate((np.nonzero(np.diff(term, prepend=-1))[0], [len(term)])).tolist() if len(term) else [0]
        for a, z in zip(starts, starts[1:]):
            d = doc[a:z]
            gaps, gap_width = _narrowed(np.diff(d, prepend=-1) - 1)
            counts, count_width = _narrowed(tf[a:z])
            heads = np.arange(0, z - a, BLOCK)
            last = d[np.append(heads[1:], z - a) - 1].astype(np.int32)
            most = np.maximum.reduceat(share[a:z], heads).astype(np.int32)
            row = (shard, int(term[a]), z - a, gaps, counts, gap_width, count_width, last.tobytes(), most.tobytes())
            for column, value in zip(out.values(), row):
                column.append(value)
        row = (shard, -1, len(starts) - 1, ids[order].tobytes(), m[order].tobytes(), 8, 8, null[order].tobytes(), b"")
        for column, value in zip(out.values(), row):
            column.append(value)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.array(out[k.split()[0]], kinds[k.split()[1]]) for k in _INDEX.split(", ")], names=list(out)
        )


def _indexed(texts: DataFrame, vocabulary: dict[bytes, int], n_docs: int, total: int, postings: int) -> DataFrame:
    """The index of ``texts`` (doc_id, text) for the terms of ``vocabulary``. The rows of a shard follow each other in one partition."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, open_, shard = held.value.get, _Open([], [], [], [], []), TaskContext.get().partitionId() << 24
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                known = np.array([v for v in map(get, found) if v is not None], np.int64)
                word, tf = np.unique(known, return_counts=True)
                if not len(word):
                    continue
                open_.words.append(word)
                open_.tfs.append(tf.astype(np.int64))
                open_.owners.append(np.full(len(word), len(open_.ids), np.int64))
                open_.ids.append(doc_id)
                open_.m.append(10 + 90 * len(found) * n_docs // total)
                open_.size += len(word)
                if open_.size >= postings:
                    yield open_.rows(shard)
                    open_, shard = _Open([], [], [], [], []), shard + 1
        if open_.ids:
            yield open_.rows(shard)

    return texts.mapInArrow(run, _INDEX)


class List:
    """Postings of a term in a shard; blocks are decompressed when they are asked for."""

    def __init__(self, row: dict, weight: int, m: np.ndarray):
        self.weight, self.m, self.df = weight, m, row["df"]
        self.gaps = np.frombuffer(row["gaps"], np.dtype(f"u{row['gap_width']}"))
        self.counts = np.frombuffer(row["counts"], np.dtype(f"u{row['count_width']}"))
        self.last = np.frombuffer(row["last"], np.int32)
        self.most = np.frombuffer(row["most"], np.int32).astype(np.int64) * weight
        self.bound = int(self.most.max())
        self.read = 0

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of the score of block ``k``."""
        self.read += 1
        a = k * BLOCK
        base = int(self.last[k - 1]) if k else -1
        docs = base + np.cumsum(self.gaps[a : a + BLOCK].astype(np.int64) + 1)
        return docs, self.weight * _share(self.counts[a : a + BLOCK].astype(np.int64), self.m[docs])

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(k) for k in which]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def search(lists: list[List], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (document, score) of a shard of ``n`` documents with a score above 0; equal scores by document."""
    lists = sorted((x for x in lists if x.weight > 0), key=lambda x: x.bound)
    upto = np.concatenate(([0], np.cumsum([x.bound for x in lists], dtype=np.int64))).tolist()
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    floor, start, width = 0, 0, _FIRST
    while start < n:
        first = next((j for j in range(len(lists)) if upto[j + 1] > floor), len(lists))  # lists before it are not essential
        if first == len(lists):
            break
        end = min(n, start + width)
        sums = np.zeros(end - start, np.int64)
        for x in lists[first:]:
            a, z = np.searchsorted(x.last, (start, end - 1))
            if a < len(x.last):
                d, s = x.blocks(range(a, min(z, len(x.last) - 1) + 1))
                inside = slice(*np.searchsorted(d, (start, end)))
                sums[d[inside] - start] += s[inside]
        at = np.nonzero(sums > max(0, floor - upto[first]))[0]
        got, at = sums[at], at + start
        for j in range(first - 1, -1, -1):
            if not len(at):
                break
            x = lists[j]
            block = np.searchsorted(x.last, at)
            there = block < len(x.last)
            most = np.where(there, x.most[np.minimum(block, len(x.last) - 1)], 0)
            stays = got + most + upto[j] > floor
            at, got, block, there = at[stays], got[stays], block[stays], there[stays]
            if there.any():
                d, s = x.blocks(np.unique(block[there]).tolist())
                spot = np.minimum(np.searchsorted(d, at), len(d) - 1)
                got = got + np.where(d[spot] == at, s[spot], 0)
            stays = got + upto[j] > floor
            at, got = at[stays], got[stays]
        if len(at):
            docs, scores = np.concatenate((docs, at)), np.concatenate((scores, got))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            floor = int(scores[-1]) if len(docs) == k else 0
        start, width = end, min(2 * width, _STRETCH)
    return docs, scores


def _searched(index: DataFrame, queries: list[tuple[int, list[int]]], weights: dict[int, int], k: int) -> DataFrame:
    """(query, shard, doc_id, score): the best of every shard."""
    held = index.sparkSession.sparkContext.broadcast((queries, weights))

    def solve(shard: int, rows: list[dict]) -> pa.RecordBatch:
        queries, weights = held.value
        at_end = rows[-1]
        if at_end["term"] != -1 or at_end["df"] != len(rows) - 1:
            raise RuntimeError(f"the rows of shard {shard} are not together")
        ids, m, null = (np.frombuffer(at_end[c], t) for c, t in (("gaps", np.int64), ("counts", np.int64), ("last", bool)))
        lists = {r["term"]: List(r, weights[r["term"]], m) for r in rows[:-1]}
        out = []
        for query, words in queries:
            docs, scores = search([lists[w] for w in words if w in lists], len(ids), k)
            out.append((np.full(len(docs), query), docs, scores))
        query, docs, scores = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(np.full(len(docs), shard)), pa.array(ids[docs], mask=null[docs]), pa.array(scores)],
            names=["query", "shard", "doc_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                rows.append(row)
                if row["term"] == -1:  # closes a shard
                    yield solve(row["shard"], rows)
                    rows = []
        if rows:
            raise RuntimeError("a shard has no end")

    return index.mapInArrow(run, "query long, shard long, doc_id long, score long")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = SHARD_POSTINGS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    Null texts have no terms; an item without terms, or with none that a document holds, has no rows, and so have all items where no document
    has a term. Equal scores go by ascending doc_id, null ids last. Repeated documents count each, repeated items are ranked each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = text_and_id(docs)
    asked = narrow(items, "item_id", "text").select("item_id", F.array_distinct(term_list(F.col("text"))).alias("term"))
    asked = global_rank(asked.filter(F.size("term") > 0), [F.col("item_id"), F.xxhash64("term")], "query")
    pairs = cut(global_rank(asked.withColumn("term", F.explode("term")), [F.col("query"), F.col("term")]))
    blocks = cut(pairs.groupBy("query").agg(F.floor((F.min("rank") - 1) / query_terms).alias("block"), F.first("item_id").alias("item_id")))
    n_docs, total = _totals(texts)
    parts = []
    for b in [r[0] for r in blocks.select("block").distinct().orderBy("block").collect()] if n_docs else []:
        own = pairs.join(blocks.filter(F.col("block") == b).select("query"), "query").select("query", "term").collect()  # bounded by query_terms
        vocabulary = {t: i for i, t in enumerate(sorted({r.term.encode("utf-8", "surrogatepass") for r in own}))}
        queries: dict[int, list[int]] = {}
        for r in own:
            queries.setdefault(r.query, []).append(vocabulary[r.term.encode("utf-8", "surrogatepass")])
        index = cut(_indexed(texts, vocabulary, n_docs, total, postings))
        df = index.filter("term >= 0").groupBy("term").agg(F.sum("df").alias("df")).collect()  # no more than the vocabulary
        weights = {r.term: weight(n_docs, r.df) for r in df}
        parts.append(_searched(index, sorted(queries.items()), weights, k))
    if not parts:
        none = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        return none.filter("false")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    some = _best(found.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(64))), ["query", "part"], k).drop("rank")
    best = _best(some, ["query"], k).join(blocks.select("query", "item_id"), "query")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
