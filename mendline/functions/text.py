"""Text expressions shared by the operators. All are JVM-side columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Regular expressions follow the Unicode classes (U) and the newline-only line
# terminator (d) of the text rules they come from.
FLAGS = "(?Ud)"

_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def let(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def strip(col: Column) -> Column:
    """Remove white space, newlines included, at both ends."""
    return F.btrim(col, F.lit(_SPACE))


def hits(col: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` in order, as an array."""
    return F.regexp_extract_all(col, F.lit(FLAGS + pattern), F.lit(group))


def count_hits(col: Column, pattern: str) -> Column:
    return F.size(hits(col, pattern)).cast("bigint")


def has(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(FLAGS + pattern))


def first_hit(col: Column, pattern: str, group: int = 1) -> Column:
    """First match, or null where there is none."""
    return F.get(hits(col, pattern, group), F.lit(0))


def line_count(col: Column) -> Column:
    """Number of lines; a closing line break does not open another one."""
    brk = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
    closed = has(col, f"(?:{brk})\\z") | (F.length(col) == 0)
    return count_hits(col, brk) + F.when(closed, F.lit(0)).otherwise(F.lit(1)).cast("bigint")


def possible(needs: tuple[tuple[str, ...], ...], text: Column) -> Column:
    """Whether ``text`` holds all fragments of one alternative; true where nothing is needed."""
    if not needs:
        return F.lit(True)
    some = None
    for fragments in needs:
        every = None
        for fragment in fragments:
            has_it = F.contains(text, F.lit(fragment))
            every = has_it if every is None else every & has_it
        some = every if some is None else some | every
    return some


def has_needing(col: Column, pattern: str, folded: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    """``has``; the pattern runs only where the lower-cased text holds what it needs."""
    return possible(needs, folded) & has(col, pattern)


def count_needing(col: Column, pattern: str, folded: Column, needs: tuple[tuple[str, ...], ...]) -> Column:
    """``count_hits``; the pattern runs only where the lower-cased text holds what it needs."""
    return F.when(~possible(needs, folded), F.lit(0).cast("bigint")).otherwise(count_hits(col, pattern))


def replace_all(col: Column, pattern: str, with_: str = "") -> Column:
    return F.regexp_replace(col, F.lit(FLAGS + pattern), F.lit(with_))


def plain_decimal(col: Column) -> Column:
    """A number as text with two decimals, without exponent."""
    return col.cast("decimal(18,2)").cast("string")
