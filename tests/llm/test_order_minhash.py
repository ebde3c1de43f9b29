"""Order MinHash against a plain reading of its definition."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from mendline.llm import order_minhash, registry
from mendline.llm.order_minhash import K, L, M, TOKEN

_ALL = (1 << 64) - 1
SCHEMA = "doc_id long, text string, at string, next string, sig string, h string, late string, to string, fingerprint string"


def folded(numbers, width=8):
    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest((x & ((1 << 8 * width) - 1)).to_bytes(width, "little"), h)
    return h


def signature(text):
    """Tuples of the L smallest members of each order, by sorting all members for each."""
    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in re.findall(TOKEN, text, re.A)]
    grams = [folded(tokens[i : i + K]) for i in range(len(tokens) - K + 1)] if len(tokens) >= K else [folded(tokens)]
    seen, members = {}, []
    for place, g in enumerate(g >> 27 for g in grams):
        n = seen[g] = seen.get(g, -1) + 1
        h = g if not n else xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(g.to_bytes(8, "little"), 42)) >> 27
        members.append((h, place))
    out = []
    for q in range(M):
        point = ((-(1 << 63) + q * ((1 << 64) // M)) & _ALL) >> 27
        least = sorted(members, key=lambda m: ((m[0] - point) % (1 << 37), m[1]))[:L]
        out.append(folded([h for h, _ in sorted(least, key=lambda m: m[1])]) & 0xFFFFFFFF)
    return out


def text_of(sig):
    return "".join(f"{v:08x}".upper() for v in sig)


def edited(rows):
    """By id descending, then by the hash of the text; (id, text, edited, next)."""
    key = lambda r: (r[0] is None, -(r[0] or 0), folded_text(r[1]))
    rows = sorted(((i, t or "") for i, t in rows), key=key)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + after[:half], after


def folded_text(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    for i, t, e, after in edited(rows):
        a, b, c = signature(t), signature(e), signature(after)
        near = lambda x, y: sum(p == q for p, q in zip(x, y)) / M
        yield i, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(b), near(a, b), near(a, c)


def same(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(expected(rows), key=order)


MESSY = [
    (5, "one two three four five six seven"), (4, "one two three one two three one two three"), (3, ""), (2, None), (1, " \t\n"),
    (0, "naïve 漢字かな 😀 word"), (-7, "x" * 5000), (6, "word " * 3000), (7, "a b"), (8, "a"), (8, "b a"), (8, "a"),
    (None, "null id"), (None, None), (9, "tail tail tail tail tail. " * 40), (-(1 << 63), "least id"), ((1 << 63) - 1, "largest id of all"),
]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_sorting(spark, ranges):
    docs = spark.createDataFrame([(i, t, *"abcdefg") for i, t in MESSY], SCHEMA)
    same(order_minhash.compared(docs, ranges=ranges).collect(), MESSY)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "just one document")], "doc_id long, text string")
    row = order_minhash.compared(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"just one just one").hexdigest()
    none = order_minhash.compared(one.filter("doc_id > 1"))
    assert none.collect() == [] and len(none.columns) == 7


def test_query_on_given_rows(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op12_order_minhash"](spark, at).collect()
    same(got, rows)
    by_text = {}
    for r, t in ((r, dict(rows)[r.doc_id]) for r in got):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_order_counts(spark):
    """Halves in the other order keep nearly all k-mers, but not the tuples that span them; edits cost according to their number."""
    words = [f"w{i}" for i in range(400)]
    swapped, few, many = words[200:] + words[:200], list(words), list(words)
    few[100] = "x"
    many[::10] = ["x"] * 40
    texts = [" ".join(x) for x in (words, swapped, few, many)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.sig for r in order_minhash.with_signature(df, "text", "sig").collect()}
    near = [sum(a == b for a, b in zip(found[0], found[i])) / M for i in range(4)]
    assert near[2] > near[1] and near[2] > near[3] > 0 and near[2] >= 0.8 and 0.2 < near[1] < 0.8


def test_plan_is_native(spark):
    df = order_minhash.compared(spark.createDataFrame(MESSY[:3], "doc_id long, text string").select("doc_id", F.col("text")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
