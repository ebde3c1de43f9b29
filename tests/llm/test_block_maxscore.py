"""Ranked search against scoring every document, and its pruning."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mendline.llm import block_maxscore, registry
from mendline.llm.block_maxscore import BLOCK, List, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, query string, shard string, score string, item_id string, rank string, term string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    for item, text in items:
        scored = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w]
            )
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            yield item, rank, i, -score


def same(df, docs, items, k=10):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected(docs, items, k), key=repr)


DOCS = [
    (5, "The cat and the dog"), (4, "the cat"), (3, "THE CAT"), (2, None), (1, ""), (0, " \t,.;"), (7, "naïve 漢字 cat É é ß"), (8, "cat " * 4000),
    (9, "dog " * 300 + "rare"), (9, "dog"), (9, "dog"), (None, "cat dog"), (None, None), (-3, "x" * 100_000), (6, "cat\u007fdog_cat`1a"), (11, "every word here"),
]
ITEMS = [(0, "cat"), (1, "CAT dog cat"), (2, None), (3, ""), (4, "absent words"), (1, "CAT dog cat"), (5, "É 漢字 rare 1a " + "the " * 9), (None, "word here the dog")]


@pytest.mark.parametrize("how", [{}, {"postings": 3, "query_terms": 2}, {"k": 2, "postings": 1}])
def test_messy_rows(spark, how):
    docs = spark.createDataFrame([(*x, *"abcdef") for x in DOCS], SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(block_maxscore.top(docs, items, **how), DOCS, ITEMS, how.get("k", 10))


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.filter("text is null"), items)):
        df = block_maxscore.top(d, i)
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.collect() == []


def test_query_on_given_rows(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    wanted = con.execute(registry.SQL["op11_block_maxscore"]).fetchall()
    df = registry.QUERIES["op11_block_maxscore"](spark, at)
    assert sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect())) == sorted(wanted) and wanted
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{at}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    same(df, docs, items)


def test_search_prunes():
    """The best of random lists equal those of plain sums, and blocks of the common list stay compressed."""
    rng = np.random.default_rng(4)
    n = 20_000
    m = rng.integers(10, 400, n)
    lists, sums = [], np.zeros(n, np.int64)
    for share, weight in ((0.9, 40), (0.3, 700), (0.01, 5000), (0.002, 7000)):
        docs = np.nonzero(rng.random(n) < share)[0]
        tf = rng.integers(1, 9, len(docs))
        part = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        heads = np.arange(0, len(docs), BLOCK)
        row = {
            "df": len(docs), "gaps": (np.diff(docs, prepend=-1) - 1).astype("u2").tobytes(), "gap_width": 2, "counts": tf.astype("u1").tobytes(), "count_width": 1,
            "last": docs[np.append(heads[1:], len(docs)) - 1].astype(np.int32).tobytes(), "most": np.maximum.reduceat(part, heads).astype(np.int32).tobytes(),
        }
        lists.append(List(row, weight, m))
        sums[docs] += weight * part
    found, scores = search(lists, n, 10)
    best = np.lexsort((np.arange(n), -sums))[:10]
    assert found.tolist() == best.tolist() and scores.tolist() == sums[best].tolist()
    assert lists[0].read < 0.5 * len(lists[0].last)
