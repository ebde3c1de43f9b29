"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule belongs to the source whose interval of cumulative weights holds the fractional part of n times the golden
ratio, so that every stretch of slots has each source's share up to a few slots. Slots are ranked per source, and slot r takes the
r-th block of that source: its documents, in shuffled order, cut into blocks of equal numbers of words. After the last block the
source begins again. The few slots that a source lacks of its target follow at the end, numbered on; the last block of a target may be partial.

Numbering is done in two steps everywhere (within a slice, and over the sums of slices), so a source with a third of all
documents is spread over many tasks. Only ids and sizes move, never texts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.functions.scale import global_rank
from mendline.llm.common import cut, narrow, unused

#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Where a word begins after white space.
_WORD_STARTS = "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"
WORD = "[^\\x20\\x09-\\x0D]+"
_CELLS = 4096
_CHUNK = 8192


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _before(df: DataFrame, keys: list[str], by: str, value: str, name: str) -> DataFrame:
    """One row per (keys, by) with the sum of ``value`` over smaller ``by`` of the same keys; for few ``by`` a key."""
    sums = df.groupBy(*keys, by).agg(F.sum(value).alias("__v"))
    upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, by, F.coalesce(F.sum("__v").over(upto), F.lit(0)).alias(name))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(skey, source, source_size, rank, target) of every source of ``sizes`` (skey, source, size).

    Sources in code point order, null last, have the weights in turn. Targets share ``share`` times all words; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight until none is above.
    """
    sources = cut(sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size")))
    ranked = global_rank(sources, [F.col("source").isNull().asc(), F.col("source").asc()])
    place = (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")
    weighed = cut(ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)))
    cap = F.col("source_size") * F.lit(float(most))
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level = 0.0
    while True:  # the set of capped sources only grows; ends after a few rounds of sums over the sources
        capped = cap <= F.col("w") * level
        full, free = weighed.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0))
        ).first()
        new = (total - full) / free if free else level
        if new <= level:
            break
        level = new
    return weighed.select(
        "skey", "source", "source_size", "rank", F.least(cap, F.col("w") * level).cast("double").alias("target")
    )


def _blocks(sources: DataFrame, slots: int | None, least_block: int) -> tuple[DataFrame, int]:
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    block = max(least_block, int(-(-total // slots)) if slots else 1)
    size, take = F.col("source_size"), F.floor(F.col("target") + 1e-6)
    n_blocks = F.ceil(size / block)
    needed = F.when(take <= size, F.ceil(take / block)).otherwise(n_blocks + F.ceil((take - size) / block))
    out = sources.withColumn("take", take.cast("long")).withColumn("n_blocks", n_blocks.cast("long"))
    return out.withColumn("needed", needed.cast("long")), block


def fraction(n: Column) -> Column:
    """Fractional part of ``n`` times the golden ratio, in whole numbers up to the last step: 53 bits of it, however large ``n``."""
    step = F.lit(Decimal(round(GOLDEN * (1 << 53)))).cast("decimal(18,0)")
    product = n.cast("decimal(18,0)") * step
    return (product % F.lit(Decimal(1 << 53)).cast("decimal(18,0)")).cast("double") / F.lit(float(1 << 53))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, skey, block, pass, used): the order in which blocks are taken, and how many words of each.

    ``sources`` has skey, rank, source_size, take, n_blocks and needed. The number of slots is that of the blocks needed.
    """
    spark = sources.sparkSession
    some = sources.filter("needed > 0").withColumn("chunk", F.floor(F.col("rank") / 1024))
    # Cumulative weights, in two steps.
    chunks = _before(some.withColumn("one", F.lit(1)), ["one"], "chunk", "needed", "b").drop("one")
    inner = Window.partitionBy("chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    n = int(some.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0])
    spans = some.join(chunks, "chunk").select(
        "skey", "needed", "n_blocks", "source_size", "take", (F.col("b") + F.sum("needed").over(inner)).alias("hi")
    )
    low, high = (F.col("hi") - F.col("needed")) / F.lit(max(n, 1)), F.col("hi") / F.lit(max(n, 1))
    cells = F.sequence(F.floor(low * _CELLS), F.floor(high * _CELLS))
    spans = cut(spans.select("*", low.alias("lo"), high.alias("up")))
    points = spark.range(n).select(F.col("id").alias("slot"), fraction(F.col("id") + 1).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * _CELLS)).withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    placed = cut(
        points.join(spans.select("skey", "lo", "up", F.explode(cells).alias("cell")), "cell")
        .filter("x >= lo and x < up")
        .select("slot", "chunk", "skey")
    )
    # Rank of a slot among those of its source, in two steps.
    offsets = _before(placed.withColumn("one", F.lit(1)), ["skey"], "chunk", "one", "b")
    place = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot"))
    ranked = placed.join(offsets, ["skey", "chunk"]).select("slot", "skey", (F.col("b") + place - 1).alias("r"))
    have = placed.groupBy("skey").agg(F.count(F.lit(1)).alias("have"))
    closing = (
        spans.join(have, "skey", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter("have < needed")
        .select(F.lit(None).cast("long").alias("slot"), "skey", F.explode(F.sequence(F.col("have"), F.col("needed") - 1)).alias("r"))
    )
    facts = spans.select("skey", "needed", "n_blocks", "source_size", "take")
    closing = cut(closing)
    if not closing.isEmpty():  # they follow the points, source by source in turn
        closing = global_rank(closing, [F.col("r").asc(), F.col("skey").asc()]).select(
            (F.col("rank") + F.lit(n - 1)).alias("slot"), "skey", "r"
        )
    taken = ranked.unionByName(closing).join(facts, "skey").filter("r < needed")
    at = F.pmod("r", F.col("n_blocks"))
    turn = F.floor(F.col("r") / F.col("n_blocks"))
    start = F.col("block") * block
    want = F.least(F.greatest(F.col("take") - F.col("pass") * F.col("source_size"), F.lit(0)), F.col("source_size"))
    return (
        taken.withColumn("block", at.cast("long"))
        .withColumn("pass", turn.cast("long"))
        .withColumn("used", F.greatest(F.lit(0), F.least(F.lit(block), want - start)).cast("long"))
        .select("slot", "skey", "block", "pass", "used")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 23,
    slots: int | None = None,
    least_block: int = 64,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot, slot_again), one row per row of ``docs``.

    slot: the first slot of the schedule that takes words of the document; slot_again: the first of the second pass over its source;
    null where nothing is taken. The order of the slots is the order of the mix.

    taken: the words of the document that the mix takes, repeats counted, at most ``most`` times its size (``most`` is at most 2).
    A block has ``least_block`` words, and more only if ``slots`` sets a highest number of slots. Null and empty texts have size 0 and nothing taken. The same
    rows give the same mix in whatever order they come; of rows equal in id, source and size it does not matter which is which.
    """
    d = narrow(docs, "doc_id", "source", "text")
    source = F.col("source").cast("string")
    sizes = cut(
        d.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
            words(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")).alias("h"),
        ).withColumn("slice", F.shiftrightunsigned("h", 64 - 10))
    )
    sources, block = _blocks(targets(sizes, weights, share, most), slots, least_block)
    sources = cut(sources)
    plan = schedule(sources, block)
    offsets = _before(sizes, ["skey"], "slice", "size", "b").join(sources.select("skey", "source_size", "target"), "skey")
    inside = Window.partitionBy("skey", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("b") + F.sum("size").over(inside) - F.col("size")
    placed = sizes.join(offsets, ["skey", "slice"]).select(
        "doc_id", "source", "skey", "size", "source_size", "target", start.alias("start")
    )
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / block))
    pieces = placed.withColumn("block", F.explode(blocks))
    first = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    last = F.col("start") + F.col("size") - F.col("block") * block
    got = F.greatest(F.lit(0), F.least(last, F.coalesce("used", F.lit(0))) - first)
    row = ["skey", "start", "doc_id", "source", "size", "source_size", "target"]
    # Empty documents share their start with the next one; they take nothing and need no block.
    full = pieces.filter("size > 0").join(plan, ["skey", "block"], "left").withColumn("got", got)
    first_slot = lambda again: F.min(F.when((F.col("got") > 0) & (F.col("pass") == again), F.col("slot")))
    some = full.groupBy(*row).agg(
        F.coalesce(F.sum("got"), F.lit(0)).cast("long").alias("taken"), first_slot(0).alias("slot"), first_slot(1).alias("slot_again")
    )
    nothing = F.lit(None).cast("long")
    none = placed.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slot": nothing, "slot_again": nothing})
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "slot", "slot_again"]
    return some.select(*columns).unionByName(none.select(*columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and with its ``n``-th word, and the white space after it."""
    parts = F.split(text, _WORD_STARTS)
    blank = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)  # white space before the first word is a part of its own
    return F.array_join(F.slice(parts, 1, (n + blank).cast("int")), "")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them, a row for each pass over a document; the pass that ends within a document has its first words only.

    The words of the rows of a source add up to its words taken. Rows are range-partitioned and sorted by their slots, so that files hold the mix
    in its order. Documents of size 0 and null texts are never taken; a cut text has its own n_chars. Rows that share an id are told apart by
    source and size; which of rows equal in all three is which does not matter. No rows give no rows.
    """
    names = {x: unused(docs, f"mix_{x}") for x in ("id", "source", "size", "nth", "slots", "slot", "words", "taken")}
    key = ["doc_id", "source", "size"]
    found = cut(mix(docs, **how).filter("taken > 0"))
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    sized = docs.withColumn(names["size"], words(docs["text"]))
    same = (
        docs["doc_id"].cast("long").eqNullSafe(F.col(names["id"]))
        & source.eqNullSafe(F.col(names["source"]))
        & (sized[names["size"]] == F.col(names["taken"] + "_of"))
    )
    if not found.groupBy(*key).count().filter("count > 1").isEmpty():
        found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("slot")))
        order = Window.partitionBy(docs["doc_id"].cast("long"), source, names["size"]).orderBy(F.xxhash64(docs["text"]))
        sized = sized.withColumn(names["nth"], F.row_number().over(order))
        same = same & (F.col(names["nth"]) == F.col(names["nth"] + "_of"))
    else:
        found = found.withColumn("nth", F.lit(1))
    passes = F.array(
        F.struct(F.col("slot").alias("slot"), F.least("taken", "size").alias("words")),
        F.struct(F.col("slot_again").alias("slot"), (F.col("taken") - F.col("size")).alias("words")),
    )
    taken = found.select(
        F.col("doc_id").alias(names["id"]),
        F.col("source").alias(names["source"]),
        F.col("size").alias(names["taken"] + "_of"),
        F.col("nth").alias(names["nth"] + "_of"),
        F.filter(passes, lambda x: x["words"] > 0).alias(names["slots"]),
    )
    met = sized.join(taken.hint("shuffle_hash"), same).withColumn(names["slot"], F.explode(names["slots"]))
    part = F.col(names["slot"])["words"]
    whole = part == F.col(names["size"])
    each = met.withColumn(names["words"], part).repartitionByRange(F.col(names["slot"])["slot"])
    each = each.sortWithinPartitions(F.col(names["slot"])["slot"])
    text = F.when(whole, docs["text"].cast("string")).otherwise(first_words(docs["text"].cast("string"), F.col(names["words"])))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(text.alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(whole, docs[f"`{c}`"]).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(docs[f"`{c}`"])
    return each.select(*out)
