"""Order MinHash fingerprints: signatures whose likeness follows the edit distance, not only the shared content.

A text is the sequence of its tokens (words with their signs; single characters in scripts without blanks). A k-mer is ``K`` tokens in a
row, and equal k-mers are numbered by their occurrence, so that the k-mers of a text are a set. Each of ``M`` orders of that set selects
its ``L`` smallest members; they are put back into the order in which they stand in the text, and the tuple is hashed. Moved passages keep
their k-mers but not their order, so they lose tuples, as edits do.

Order j ranks a member by its 64-bit hash, counted round from the j-th of M evenly spaced points. Two texts agree on the
smallest member of such an order with the chance of their Jaccard similarity, as for any random order, but all M orders are read off one
sorted array: the points are sorted into it, and each takes the L members that follow it.

Everything is an array expression of a row, so no k-mer ever moves. An array holds hash and place in one long (37 and 27 bits), which keeps
the sort on primitive values; texts have fewer than 2^27 tokens.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.llm.common import text_and_id

K, L, M = 3, 2, 64
#: Runs of signs of the alphabets below U+0E00, which put blanks between words; any other sign alone.
TOKEN = r"[\x21-\u0DFF]++|\S"
_PLACE = 27
_LOW = (1 << _PLACE) - 1
#: Most ranges into which ids are cut: what the driver holds and a task looks up, whatever the corpus.
MOST_RANGES = 1 << 14


def _place(v: Column) -> Column:
    return v.bitwiseAND(F.lit(_LOW))


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(place.cast("long"))


def with_signature(df: DataFrame, text: str, name: str, k: int = K, l: int = L, m: int = M) -> DataFrame:
    """``df`` and the signature of the column ``text``: ``m`` ints. ``df`` is a table of the caller's with its own column names.

    A text of fewer than ``k`` tokens has one k-mer, all of it; one without tokens has that of the empty sequence. A text of fewer than
    ``l`` k-mers has shorter tuples.
    """
    keep = df.columns
    token, kmer, start, member, point = (f"{name}__{x}" for x in ("token", "kmer", "start", "member", "point"))
    t, s, st, y, p = map(F.col, (token, kmer, start, member, point))
    out = df.withColumn(token, F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x)))
    several = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0))),
        lambda i: _packed(F.xxhash64(*[F.get(t, i + j) for j in range(k)]), i),
    )
    out = out.withColumn(kmer, F.sort_array(F.when(F.size(t) >= k, several).otherwise(F.array(_packed(F.xxhash64(t), F.lit(0))))))
    # Equal k-mers lie side by side, in the order of the text. The first of a run stands for itself, the others for a hash of their number.
    places = F.sequence(F.lit(0), F.size(s) - 1)
    same = lambda i: F.shiftrightunsigned(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), _PLACE) == 0
    out = out.withColumn(start, F.filter(places, lambda i: (i == 0) | ~same(i)))
    # Before the r-th of the others, which stands at i, i - r runs have begun.
    number = lambda i, r: i - F.get(st, i - r - 1)
    others = F.transform(
        F.filter(places, lambda i: (i > 0) & same(i)),
        lambda i, r: _packed(F.xxhash64(F.shiftrightunsigned(F.get(s, i), _PLACE), number(i, r)), _place(F.get(s, i))),
    )
    numbered = F.sort_array(F.concat(F.transform(st, lambda i: F.get(s, i)), others))
    out = out.withColumn(member, F.when(F.size(st) == F.size(s), s).otherwise(numbered)).drop(kmer, start)
    # The points, in ascending order, among the members: point q stands at its rank plus q.
    step = (1 << 64) // m
    marks = F.from_json(F.lit(json.dumps([((-(1 << 63) + q * step) & ~_LOW) | (_LOW - q) for q in range(m)])), "array<bigint>")
    out = out.withColumn(point, F.sort_array(F.concat(y, marks)))
    is_mark = lambda i: _place(F.get(p, i)) > F.lit(_LOW - m)
    out = out.withColumn(point, F.filter(F.sequence(F.lit(0), F.size(p) - 1), is_mark))
    # Place before hash, to sort the selected by their places.
    turned = lambda v: F.shiftleft(_place(v), 64 - _PLACE).bitwiseOR(F.shiftrightunsigned(v, _PLACE))
    chosen = lambda i, q: F.sort_array(
        F.transform(F.sequence(F.lit(0), F.least(F.lit(l), F.size(y)) - 1), lambda r: turned(F.get(y, F.pmod(i - q + r, F.size(y)))))
    )
    hashed = lambda found: F.xxhash64(F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << (64 - _PLACE)) - 1))))
    low = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")
    return out.withColumn(name, F.transform(p, lambda i, q: low(hashed(chosen(i, q))))).select(*keep, name)


def as_text(signature: Column) -> Column:
    """Eight hex digits for each tuple."""
    return F.array_join(F.transform(signature, lambda v: F.lpad(F.hex(v.cast("long") + F.lit(1 << 31)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def fingerprints(docs: DataFrame, k: int = K, l: int = L, m: int = M) -> DataFrame:
    """(doc_id, fingerprint) of every row; a null text counts as empty."""
    return with_signature(text_and_id(docs), "text", "sig", k, l, m).select("doc_id", as_text(F.col("sig")).alias("fingerprint"))


def _bounds(keys: DataFrame, ranges: int) -> list[list]:
    """The smallest key of each of about ``ranges`` ranges, ascending."""
    ranged = keys.repartitionByRange(ranges, "late", "down", "h").groupBy(F.spark_partition_id().alias("range"))
    found = ranged.agg(F.min(F.struct("late", "down", "h")).alias("k")).select("k.*").collect()  # one row for each range
    return sorted([int(r.late), r.down, r.h] for r in found)


def _range_of(key: Column, bounds: list[list]) -> tuple[Column, Column]:
    """The range in which ``key`` lies, and whether it is the first key of it: looked up in two steps."""
    kind = "array<struct<late:int,down:bigint,h:bigint>>"
    stride = max(1, int(len(bounds) ** 0.5))
    given = lambda b: F.from_json(F.lit(json.dumps([dict(zip(("late", "down", "h"), x)) for x in b])), kind)
    every, coarse = given(bounds), given(bounds[::stride])
    upto = lambda part: F.greatest(F.size(F.filter(part, lambda b: b <= key)) - 1, F.lit(0))
    start = upto(coarse) * stride
    at = start + upto(F.slice(every, start + 1, stride))
    return at, F.get(every, at) == key


def edited(docs: DataFrame, ranges: int | None = None, k: int = K, l: int = L, m: int = M) -> DataFrame:
    """(doc_id, n_chars, edited, signature, edited_signature, next_signature), one row per row of ``docs``.

    edited: the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. The next
    document has the next smaller doc_id (after the last: the first; a single document follows itself). Equal ids are ordered by a hash of
    their texts, null ids come last, null texts count as empty. Repeated rows follow each other. No rows give no rows.

    Documents are dealt out by ranges of the order, and the first document of each range is sent to the range before as well, so a
    text crosses the network once; a third of all rows under one id are dealt out by their texts' hashes.
    """
    spark = docs.sparkSession
    d = text_and_id(docs).select(
        "doc_id",
        "text",
        F.col("doc_id").isNull().cast("int").alias("late"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"),  # falls as the id rises, without overflow
        F.xxhash64("text").alias("h"),
    )
    ranges = ranges or min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(d.select("late", "down", "h"), ranges)
    at, _ = _range_of(F.struct("late", "down", "h"), bounds)
    own = with_signature(d.withColumn("at", at), "text", "signature", k, l, m)
    _, leads = _range_of(F.struct("late", "down", "h"), bounds)
    before = F.pmod(F.col("at") - 1, F.lit(max(1, len(bounds))))
    here = F.struct(F.col("at").alias("at"), F.lit(False).alias("guest"))
    there = F.struct(before.alias("at"), F.lit(True).alias("guest"))
    placed = own.withColumn("to", F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy("to.at").orderBy("to.guest", "late", "down", "h")
    met = placed.withColumns({"next": F.lead("text").over(order), "next_signature": F.lead("signature").over(order)})
    half = F.floor(F.length("text") / 2).cast("int")
    whole = met.filter(~F.col("to.guest")).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half)).alias("edited"),
        "signature",
        "next_signature",
    )
    return with_signature(whole, "edited", "edited_signature", k, l, m)


def compared(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; see ``edited``."""
    return edited(docs, **how).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
