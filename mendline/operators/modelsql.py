"""Facts read from model SQL text: template stripping, output columns, accepted values.

Columns come from token rules on masked text, not from a parser. Known approximations: only the select list
of the last statement's first top-level SELECT counts, ``t.*`` yields nothing, and an expression
without alias yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.text import FLAGS, first_hit, hits, let, replace_all, strip

# Stand for the brackets of a part that is done; what was between them is kept only for CTE bodies.
_OPEN, _CLOSE = "\x02", "\x03"


def strip_templates(sql: Column) -> Column:
    """Expression blocks become the ``ref`` name, ``source_table`` or nothing; statement blocks go away."""

    def value(block: Column) -> Column:
        ref = F.regexp_extract(block, FLAGS + R.REF_CALL, 1)
        schema, table = (F.regexp_extract(block, FLAGS + R.SOURCE_CALL, i) for i in (1, 2))
        return F.when(ref != "", ref).when(table != "", F.concat(schema, F.lit("_"), table)).otherwise("")

    between = F.split(sql, FLAGS + R.TEMPLATE_BLOCK, -1)
    values = F.concat(F.transform(hits(sql, R.TEMPLATE_BLOCK), value), F.array(F.lit("")))
    text = F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, b)), "")
    return replace_all(text, R.TEMPLATE_STATEMENT)


def strip_comments(sql: Column) -> Column:
    """Line and block comments removed; quoted text is left alone."""
    return replace_all(sql, r"('[^']*')|--[^\n]*|/\*(?s:.*?)\*/", "$1")


def mask_literals(sql: Column) -> Column:
    """Quoted text emptied, so that keywords inside it are not seen."""
    return replace_all(sql, r"'[^']*'", "''")


def _inside_out(text: Column, bracket: str, pattern: str, replacement: str) -> Column:
    """Replace bracketed parts until a round changes nothing. The opening brackets bound the rounds, so any depth is covered."""
    rounds = F.sequence(F.lit(0), F.length(text) - F.length(F.replace(text, F.lit(bracket), F.lit(""))))

    def state(new: Column, old: Column) -> Column:
        return F.struct(new.alias("text"), (F.contains(new, F.lit(bracket)) & (new != old)).alias("more"))

    def turn(done: Column, _: Column) -> Column:
        changed = let(done["text"], lambda old: let(replace_all(old, pattern, replacement), lambda new: state(new, old)))
        return F.when(done["more"], changed).otherwise(done)

    start = F.struct(text.alias("text"), F.contains(text, F.lit(bracket)).alias("more"))
    return F.aggregate(rounds, start, turn, lambda done: done["text"])


def _select_list(top: Column) -> Column:
    """Items of the first SELECT in bracket-free text."""
    body = F.regexp_extract(top, r"(?Udis)\bSELECT\b\s*(?:DISTINCT\b|ALL\b)?(.*?)(?:\bFROM\b|\z)", 1)
    return F.transform(F.split(body, ","), strip)


def _named(items: Column) -> Column:
    """Output names of the items up to the first ``*``."""
    star = F.array_position(items, "*")
    kept = F.when(star > 0, F.slice(items, F.lit(1), star.cast("int") - 1)).otherwise(items)

    def name(item: Column) -> Column:
        # An explicit alias, a plain column, or an alias without AS.
        alias = first_hit(item, r"(?i)\bAS\s+[\"`]?(\w+)[\"`]?$")
        plain = first_hit(item, r"^(?:[\"`]?\w+[\"`]?\.)*[\"`]?([A-Za-z_]\w*)[\"`]?$")
        bare = first_hit(item, r"[\w\"`'\x03]\s+([A-Za-z_]\w*)$")
        return F.coalesce(alias, plain, F.when(F.lower(bare) != "end", bare))

    return F.array_compact(F.transform(kept, name))


def model_facts(models: DataFrame) -> DataFrame:
    """``(model, columns, refs, hints)``: all that inference reads from a model's SQL, in one pass over the text.

    ``columns`` are the names the final SELECT returns, where ``*`` takes the columns of the last CTE. ``refs`` are the
    models it refers to. ``hints`` are (column, value) pairs from ``WHEN col = 'v'`` and then ``col IN ('a', …)``, in order of
    first use; ``NOT IN`` lists are no hint. Each step is its own projection, so that a text used twice is computed once.
    """
    refs = F.array_distinct(hits(F.col("sql"), R.REF_BLOCK, 1))
    masked = mask_literals(strip_comments(strip_templates(F.col("sql"))))
    parts = models.select(
        F.col("name").alias("model"), refs.alias("refs"), _hint_pairs(F.col("sql")).alias("hints"), F.split(masked, ";").alias("parts")
    )
    last = parts.select(
        "model", "refs", "hints", F.try_element_at(F.filter("parts", lambda s: strip(s) != ""), F.lit(-1)).alias("last")
    )
    # Brackets are worked off from the inside: CTE bodies stay between marks, all else in brackets goes.
    bodies = _inside_out(F.col("last"), "(", r"(?i)(\bAS\s*)\(([^()]*)\)|\([^()]*\)", f"$1{_OPEN}$2{_CLOSE}")
    marked = last.select("model", "refs", "hints", bodies.alias("bodies"))
    top = _inside_out(F.col("bodies"), _OPEN, r"\x02[^\x02\x03]*\x03", _CLOSE)
    body = F.try_element_at(hits(F.col("bodies"), r"(?i)\bAS\s*\x02([^\x02\x03]*+(?:\x02\x03[^\x02\x03]*+)*+)\x03", 1), F.lit(-1))
    lists = marked.select("model", "refs", "hints", _select_list(top).alias("items"), body.alias("body"))
    inner = F.when(F.array_contains("items", "*"), _select_list(F.col("body")))
    named = lists.select("model", "refs", "hints", "items", inner.alias("inner")).select(
        "model", "refs", "hints", _named(F.col("items")).alias("own"), _named(F.col("inner")).alias("inner")
    )
    columns = F.concat("own", F.coalesce("inner", F.array().cast("array<string>")))
    return named.select("model", columns.alias("columns"), "refs", "hints")


def _hint_pairs(sql: Column) -> Column:
    def pair(column: Column, value: Column) -> Column:
        return F.struct(F.lower(column).alias("column"), value.alias("value"))

    def part(match: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(match, FLAGS + pattern, group)

    # The whole text is searched once per pattern; the groups are read off the short matches.
    equal = F.transform(
        hits(sql, R.WHEN_EQUALS), lambda m: pair(part(m, R.WHEN_EQUALS, 1), part(m, R.WHEN_EQUALS, 2))
    )
    lists = F.flatten(
        F.transform(
            hits(sql, R.IN_LIST),
            lambda m: F.transform(
                hits(part(m, R.IN_LIST, 2), R.QUOTED_VALUE, 1), lambda v: pair(part(m, R.IN_LIST, 1), v)
            ),
        )
    )
    return F.array_distinct(F.concat(equal, F.filter(lists, lambda p: p["column"] != "not")))


def columns_of(facts: DataFrame) -> DataFrame:
    """``(model, column, ordinal)``."""
    # An expression, not the bare column: Spark would test a bare column for emptiness ahead of everything that builds it.
    names = F.array_compact("columns")
    return facts.select("model", F.posexplode(names).alias("ordinal", "column")).select(
        "model", "column", (F.col("ordinal") + 1).cast("bigint").alias("ordinal")
    )


def refs_of(facts: DataFrame) -> DataFrame:
    """``(model, name)`` of the models each model refers to."""
    return facts.select("model", F.explode(F.array_compact("refs")).alias("name"))


def hints_of(facts: DataFrame) -> DataFrame:
    """``(model, column, accepted)``: accepted values per column. No shuffle: a model is one row."""
    names = F.array_distinct(F.transform("hints", lambda p: p["column"]))
    return facts.select("model", "hints", F.explode(names).alias("column")).select(
        "model",
        "column",
        F.transform(F.filter("hints", lambda p: p["column"] == F.col("column")), lambda p: p["value"]).alias("accepted"),
    )


def model_columns(models: DataFrame) -> DataFrame:
    """``(model, column, ordinal)`` of ``models(name, sql)``."""
    return columns_of(model_facts(models))


def model_refs(models: DataFrame) -> DataFrame:
    return refs_of(model_facts(models))


def accepted_value_hints(models: DataFrame) -> DataFrame:
    return hints_of(model_facts(models))
