"""Log analytics over corpora of log files and log lines.

Two table forms are read:

* ``files(path, framework, content)``: one row per file. Every rule is a projection, so nothing
  is shuffled before the matches are cut out and ``content`` is dropped.
* ``lines(path, line_no, text)``: one row per line, for files too large for one row. ``line_no``
  orders the lines of a path and may have gaps. No step gathers a path in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.scale import cut
from mendline.functions.text import count_hits, first_hit, has, hits, let, possible, strip

BLOCK_LINES = 1_000_000


def tail(content: Column, chars: int | None) -> Column:
    """The last ``chars`` characters, or all of them for ``None``."""
    return content if chars is None else F.right(content, F.lit(chars))


def head(content: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all of them for ``None``."""
    return content if chars is None else F.left(content, F.lit(chars))


def split_lines(files: DataFrame, *keep: str) -> DataFrame:
    """Lines of each file, numbered from 1; ``keep`` names further columns to carry."""
    return files.select(
        "path", *keep, F.posexplode(F.split("content", "\n")).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("bigint") + 1)


# --- snippets ---------------------------------------------------------------------------------


def _worth(rule: R.Rule, text: Column, folded: Column) -> Column:
    return possible(rule.needs, folded if rule.ignores_case else text)


def _rule_hits(rule: R.Rule, text: Column, folded: Column) -> Column:
    """All matches of a rule; the pattern runs only on text that can match."""
    none = F.array().cast("array<string>")
    return F.when(_worth(rule, text, folded), hits(text, rule.pattern, rule.group)).otherwise(none)


def _rule_has(rule: R.Rule, text: Column, folded: Column) -> Column:
    return _worth(rule, text, folded) & has(text, rule.pattern)


def _any_rule(rules: list[R.Rule], text: Column, folded: Column) -> Column:
    test = F.lit(False)
    for rule in rules:
        test = test | _rule_has(rule, text, folded)
    return test


def _issue_rules(strict: bool) -> list[tuple[str, R.Rule]]:
    return [(severity, R.JVM_ISSUES_STRICT.get(rule.rule_id, rule) if strict else rule) for severity, rule in R.JVM_ISSUES]


def _by_framework(name: Column, sets: dict[str, list[R.Rule]], use: Callable[[list[R.Rule]], Column]) -> Column:
    """``use(rules)`` of the framework's set; an unknown framework has the ``generic`` one."""
    chosen = F.when(F.lit(False), use(sets["generic"]))
    for known, rules in sets.items():
        if known != "generic":
            chosen = chosen.when(name == known, use(rules))
    return chosen.otherwise(use(sets["generic"]))


def extract_errors(
    files: DataFrame, rule_sets: dict[str, list[R.Rule]] | None = None, snippet_chars: int | None = None
) -> DataFrame:
    """Every match of every rule of the file's framework, in rule order and then position.

    An unknown framework gets the ``generic`` rules. ``snippet_chars`` cuts the snippets before they leave the scan,
    ``rules.SNIPPET_CHARS`` by custom.
    """
    content, folded = F.col("content"), F.col("folded")

    def found(rules: list[R.Rule]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(no).alias("rule_no"),
                    F.lit(rule.rule_id).alias("rule_id"),
                    F.transform(_rule_hits(rule, content, folded), lambda m: head(strip(m), snippet_chars)).alias("snippets"),
                )
                for no, rule in enumerate(rules, 1)
            ]
        )

    read = files.select("path", F.lower("framework").alias("framework"), "content", F.lower("content").alias("folded"))
    all_rules = _by_framework(F.col("framework"), rule_sets or R.EXTRACTION_RULES, found)
    return read.select("path", "framework", F.explode(all_rules).alias("r")).select(
        "path", "framework", "r.rule_no", "r.rule_id", F.posexplode("r.snippets").alias("pos", "snippet")
    )


def dedup_snippets(snippets: DataFrame) -> DataFrame:
    """First of equal snippets per file, over all rules; ``snippet_key`` shows the first 200 characters.

    A minimum per snippet rather than a ranked window: repeats collapse before the shuffle.
    """
    return (
        snippets.groupBy("path", "framework", "snippet")
        .agg(F.min(F.struct("rule_no", "pos", "rule_id")).alias("first"), F.count("*").alias("n_repeats"))
        .select(
            "path",
            "framework",
            "first.rule_no",
            "first.rule_id",
            "first.pos",
            "snippet",
            F.left("snippet", F.lit(R.SNIPPET_KEY_CHARS)).alias("snippet_key"),
            "n_repeats",
        )
    )


def files_without_errors(files: DataFrame) -> DataFrame:
    """Files for which no rule of their framework matches. A filter; no join is needed."""
    name = F.lower("framework")

    def no_error(text: Column, folded: Column) -> Column:
        return ~_by_framework(name, R.EXTRACTION_RULES, lambda rules: _any_rule(rules, text, folded))

    clean = let(F.col("content"), lambda text: let(F.lower(text), lambda folded: no_error(text, folded)))
    return files.filter(clean).select("path", name.alias("framework"))


# --- snippets of line tables -----------------------------------------------------------------------


def _kind(rule: R.Rule) -> str:
    """How far a rule reaches: within a line, to the end of the file, or over lines of a form of their own."""
    if rule.rule_id in ("traceback", "jvm_exception"):
        return rule.rule_id
    if rule.pattern.startswith("(?s)"):
        if not rule.pattern.endswith(".*"):
            raise ValueError(f"rule {rule.rule_id} has no line form")
        return "rest"
    return "line"


def extract_errors_from_lines(
    lines: DataFrame,
    rule_sets: dict[str, list[R.Rule]] | None = None,
    block_lines: int = BLOCK_LINES,
    snippet_chars: int | None = None,
) -> DataFrame:
    """``extract_errors`` on ``lines(path, framework, line_no, text)``: ``(path, framework, rule_no, rule_id, line_no, pos, snippet)``.

    ``line_no`` is where a match begins and ``pos`` its place among those of the rule in that line. Blanks in a rule do not reach over a line
    break. A match over many lines is gathered in one row: give ``snippet_chars`` where files are larger than a row may be.
    """
    sets = rule_sets or R.EXTRACTION_RULES
    read = lines.select("path", F.lower("framework").alias("framework"), "line_no", "text")
    text, folded = F.col("text"), F.col("folded")

    def in_line(rules: list[R.Rule]) -> Column:
        each = [
            F.struct(F.lit(no).alias("rule_no"), F.lit(r.rule_id).alias("rule_id"), F.transform(_rule_hits(r, text, folded), strip).alias("snippets"))
            for no, r in enumerate(rules, 1)
            if _kind(r) == "line"
        ]
        return F.array(*each).cast("array<struct<rule_no: int, rule_id: string, snippets: array<string>>>")

    found = [
        read.withColumn("folded", F.lower("text"))
        .select("path", "framework", "line_no", F.explode(_by_framework(F.col("framework"), sets, in_line)).alias("r"))
        .select("path", "framework", "r.rule_no", "r.rule_id", "line_no", F.posexplode("r.snippets").alias("pos", "snippet"))
    ]
    whole = _gather(_reached(read, sets, block_lines), snippet_chars)
    found.append(
        whole.select("path", "framework", "seg.rule_no", "seg.rule_id", "line_no", F.lit(0).alias("pos"), "snippet")
    )
    return reduce(DataFrame.unionByName, found).withColumn("snippet", head(F.col("snippet"), snippet_chars))


_HEADS = {"traceback": r"Traceback \(most recent call last\)[^\n]*+", "jvm_exception": r"(?:java\.lang\.|org\.apache\.|py4j\.)\S+Exception[^\n]*"}


def _reached(lines: DataFrame, sets: dict[str, list[R.Rule]], block_lines: int) -> DataFrame:
    """Lines of the matches of all rules that reach over lines: ``(path, framework, seg, block, line_no, head, text)``.

    One reading finds where a path first has the head of a rule; a second takes the lines from there on, once for each rule that begins, and
    paths where none begins drop out. A rule that reaches to the end of its file has them all. For the others a *hard* line opens a
    segment: for a traceback a line that is neither empty nor indented, for an exception a stack frame. Two running maxima
    tell the lines from the first head of a segment on; they are taken in blocks, and one row per block carries them to the next. Hard lines
    without a head go without their text.
    """
    text, no = F.col("text"), F.col("line_no")

    def heads(rules: list[R.Rule]) -> Column:
        each = [
            F.struct(
                F.lit(i).alias("rule_no"),
                F.lit(r.rule_id).alias("rule_id"),
                F.lit(_kind(r)).alias("kind"),
                F.when(possible(r.needs, text), first_hit(text, _HEADS.get(r.rule_id, r.pattern), 0)).alias("head"),
            )
            for i, r in enumerate(rules, 1)
            if _kind(r) != "line"
        ]
        return F.array(*each).cast("array<struct<rule_no: int, rule_id: string, kind: string, head: string>>")

    begun = F.filter(_by_framework(F.col("framework"), sets, heads), lambda h: h["head"].isNotNull())
    rule = ["rule_no", "rule_id", "kind"]
    starts = (
        lines.select("path", "framework", "line_no", F.explode(begun).alias("h"))
        .groupBy("path", "framework", *[F.col(f"h.{c}").alias(c) for c in rule])
        .agg(F.min(F.struct("line_no", "h.head")).alias("start"))
        .groupBy("path", "framework")
        .agg(F.collect_list(F.struct(*rule, "start")).alias("tracks"))  # one for each rule of a set at most
    )
    met = lines.join(starts, ["path", "framework"])
    track = F.explode(F.filter("tracks", lambda t: t["start"]["line_no"] <= no))
    rows = met.select("path", "framework", "line_no", "text", track.alias("t"))
    seg = lambda at: F.struct(F.col("t.rule_no").alias("rule_no"), F.col("t.rule_id").alias("rule_id"), at.alias("at"))
    first = F.when(no == F.col("t.start.line_no"), F.col("t.start.head"))
    zero = F.lit(0).cast("bigint")
    rest = rows.filter(F.col("t.kind") == "rest").select(
        "path", "framework", seg(zero).alias("seg"), zero.alias("block"), "line_no", first.alias("head"), F.coalesce(first, text).alias("text")
    )
    traced = F.col("t.kind") == "traceback"
    is_hard = F.when(traced, (text != "") & ~has(text, r"^\s")).otherwise(has(text, r"^\s*at "))
    of = {r.rule_id: r for rules in sets.values() for r in rules}
    begins = lambda name: F.when(possible(of[name].needs, text), first_hit(text, _HEADS[name], 0)) if name in of else F.lit(None).cast("string")
    marked = rows.filter(F.col("t.kind") != "rest").select(
        "path", "framework", "line_no", "t", F.floor(no / F.lit(block_lines)).alias("block"), F.when(is_hard, no).alias("hard"),
        F.when(traced, begins("traceback")).otherwise(begins("jvm_exception")).alias("head"), "text",
    )
    marked = marked.withColumn("text", F.when(F.col("hard").isNull(), text))
    key = ["path", "framework", "t"]
    at_head = F.when(F.col("head").isNotNull(), no)
    so_far = Window.partitionBy(*key, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        marked.withColumn("last_hard", F.max("hard").over(so_far))
        .withColumn("last_head", F.max(at_head).over(so_far))
        .withColumn("head_before", F.max(at_head).over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    )
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*key, "block")
        .agg(F.max("hard").alias("h"), F.max(at_head).alias("b"))
        .select(*key, "block", F.max("h").over(earlier).alias("carry_hard"), F.max("b").over(earlier).alias("carry_head"))
    )
    opened = F.coalesce(F.greatest("last_hard", "carry_hard"), F.lit(-1).cast("bigint"))
    segments = (
        running.join(carried, [*key, "block"])
        .withColumn("at", opened)
        .filter(F.greatest("last_head", "carry_head") >= F.col("at"))
        .withColumn("begins", F.coalesce(F.greatest("head_before", "carry_head"), F.lit(-2)) < F.col("at"))
        .select(
            "path", "framework", seg(F.col("at")).alias("seg"), "block", "line_no", "head",
            F.when(F.col("begins") | F.col("hard").isNotNull(), F.col("head")).otherwise(text).alias("text"),
        )
    )
    return rest.unionByName(segments)


def _gather(members: DataFrame, chars: int | None) -> DataFrame:
    """``(path, framework, line_no, snippet)`` of segments: the head of the first line, then whole lines."""
    shown = members if chars is None else _first_chars(members, chars)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "head", "text")))
    rest = F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: F.concat(F.lit("\n"), x["text"]))
    whole = F.concat(F.col("l")[0]["head"], F.array_join(rest, ""))
    return shown.groupBy("path", "framework", "seg").agg(ordered.alias("l")).select(
        "path", "framework", "seg", F.col("l")[0]["line_no"].alias("line_no"), strip(whole).alias("snippet")
    )


def dedup_line_snippets(snippets: DataFrame) -> DataFrame:
    """First of equal snippets per file of a line table, with its line and the number of repeats."""
    return (
        snippets.groupBy("path", "framework", "snippet")
        .agg(F.min(F.struct("rule_no", "line_no", "pos", "rule_id")).alias("first"), F.count("*").alias("n_repeats"))
        .select("path", "framework", "first.rule_no", "first.rule_id", "first.line_no", "snippet", "n_repeats")
    )


def paths_without_errors(lines: DataFrame, rule_sets: dict[str, list[R.Rule]] | None = None) -> DataFrame:
    """``files_without_errors`` of a line table: a partial count per path, no line moves."""
    sets = rule_sets or R.EXTRACTION_RULES
    begins = {"traceback": r"Traceback \(most recent call last\)", "jvm_exception": r"(?:java\.lang\.|org\.apache\.|py4j\.)\S+Exception"}
    name = F.lower("framework")

    def hit(rules: list[R.Rule]) -> Column:
        return _any_rule([r._replace(pattern=begins.get(r.rule_id, r.pattern)) for r in rules], F.col("text"), F.lower("text"))

    flagged = lines.select("path", name.alias("framework"), _by_framework(name, sets, hit).alias("hit"))
    return flagged.groupBy("path", "framework").agg(F.max("hit").alias("hit")).filter("not hit").select("path", "framework")


# --- JVM exception chains ---------------------------------------------------------------------


def _unique_chains(chains: DataFrame) -> DataFrame:
    return (
        chains.groupBy("path", "chain")
        .agg(F.min("pos").alias("pos"), F.count("*").alias("n_repeats"))
        .select("path", "pos", "chain", F.left("chain", F.lit(R.CHAIN_KEY_CHARS)).alias("chain_key"), "n_repeats")
    )


def exception_chains(files: DataFrame, tail_chars: int | None = None, chain_chars: int | None = None) -> DataFrame:
    """Distinct exception chains (head, frames, ``Caused by`` parts) of each file; ``chain_key`` shows the first 150 characters.

    ``tail_chars`` (here and below) restricts the analysis to the recent end of a file, ``rules.JVM_TAIL_CHARS`` by custom;
    ``chain_chars`` cuts the chains, ``rules.CHAIN_CHARS`` by custom.
    """
    rule = R.Rule("chain", R.JVM_CHAIN, needs=R.JVM_CHAIN_NEEDS)
    none = F.array().cast("array<string>")
    begun = lambda text: F.when(~possible(R.JVM_CHAIN_STARTS, text), none).otherwise(_rule_hits(rule, text, text))
    found = let(tail(F.col("content"), tail_chars), begun)
    shown = F.transform(found, lambda m: head(strip(m), chain_chars))
    raw = files.select("path", F.posexplode(shown).alias("pos", "chain"))
    return _unique_chains(raw.withColumn("pos", F.col("pos").cast("bigint")))


def chain_findings(chains: DataFrame) -> DataFrame:
    """Exception chains of each file as one finding, with the earliest as evidence."""
    return (
        chains.groupBy("path")
        .agg(F.sum("n_repeats").alias("n"), F.min(F.struct("pos", "chain_key")).alias("first"))
        .select(
            F.lit("log").alias("family"),
            F.col("path").alias("artifact"),
            F.lit("exception_chain").alias("rule_id"),
            F.lit("ERROR").alias("severity"),
            "n",
            F.col("first.chain_key").alias("evidence"),
        )
    )


def first_per_path(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each path with the path's total.

    The rank filter becomes a per-partition group limit, so a path of any size ships ``n`` rows
    per task; the totals are a partial count.
    """
    rank = F.row_number().over(Window.partitionBy("path").orderBy(order))
    totals = rows.groupBy("path").agg(F.count("*").alias("n_total"))
    return rows.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n).join(totals, "path")


def chain_marks(text: Column) -> list[Column]:
    """What decides how a line stands to a chain: blank, frame, bare_at, caused, and head, the part of it that begins a chain."""
    # Most lines start with a digit, letter or bracket; only the others can be blank or indented.
    lead = F.left(text, F.lit(1))
    spaced = (lead <= " ") | (lead >= "\x7f")
    return [
        (spaced & has(text, r"^\s*$")).alias("blank"),
        (spaced & has(text, r"^\s+at [^\n]")).alias("frame"),
        (F.startswith(text, F.lit("at ")) & (F.length(text) > 3)).alias("bare_at"),
        F.startswith(text, F.lit("Caused by:")).alias("caused"),
        F.when(possible(R.JVM_CHAIN_NEEDS, text), first_hit(text, R.JVM_HEAD, 0)).alias("head"),
    ]


def exception_chains_from_lines(
    lines: DataFrame, block_lines: int = BLOCK_LINES, chain_chars: int | None = None
) -> DataFrame:
    """``exception_chains`` on a line table, exact for files of any length.

    A line is *hard* when it cannot continue a chain. A chain runs from the first head line at or after
    the last hard line up to the next hard line, so two running maxima decide membership: the last hard
    line and the last head line. They are taken inside blocks of ``block_lines`` lines; one
    summary row per block carries them to the following blocks. The text is read and shuffled once: lines that can
    be in no chain are dropped right behind it. ``chain_chars`` cuts the chains; a whole chain is gathered in one row.
    """
    no = F.col("line_no")
    kinds = lines.select(
        "path", "line_no", F.floor(no / F.lit(block_lines)).alias("block"), *chain_marks(F.col("text")), head(F.col("text"), chain_chars).alias("text")
    ).withColumn("text", F.when(F.col("blank") | F.col("frame") | F.col("bare_at") | F.col("caused"), F.col("text")))

    def hard(after_blank: Column) -> Column:
        return ~(
            F.col("blank") | F.col("frame") | (F.col("bare_at") & after_blank) | (F.col("caused") & ~after_blank)
        )

    in_block = Window.partitionBy("path", "block").orderBy("line_no")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The first line of a block does not see the line before it; both outcomes are kept for it.
    first = F.col("after_blank").isNull()
    is_hard = ~first & hard(F.col("after_blank"))
    is_head = F.col("head").isNotNull()
    running = (
        kinds.withColumn("after_blank", F.lag("blank").over(in_block))
        .withColumn("ends_block", F.lead("line_no").over(in_block).isNull())
        .select(
            "path",
            "block",
            "line_no",
            "head",
            "text",
            "blank",
            "ends_block",
            F.when(first & hard(F.lit(True)), no).alias("hard_if_blank"),
            F.when(first & hard(F.lit(False)), no).alias("hard_if_not"),
            F.max(F.when(is_hard, no)).over(so_far).alias("last_hard"),
            F.max(F.when(is_head, no)).over(so_far).alias("last_head"),
            (is_hard & ~is_head).alias("outside"),
        )
    )
    # The last line of every block stays, for the maxima it has reached.
    kept = cut(running.filter(~F.col("outside") | F.col("ends_block")).drop("outside"))
    summary = kept.groupBy("path", "block").agg(
        F.max("last_hard").alias("last_hard"),
        F.max("last_head").alias("last_head"),
        F.max("hard_if_blank").alias("hard_if_blank"),
        F.max("hard_if_not").alias("hard_if_not"),
        F.max(F.when(F.col("ends_block"), F.col("blank"))).alias("ends_blank"),
    )
    by_block = Window.partitionBy("path").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    after_blank_block = F.coalesce(F.lag("ends_blank").over(by_block), F.lit(False))
    carried = summary.withColumn(
        "first_hard", F.when(after_blank_block, F.col("hard_if_blank")).otherwise(F.col("hard_if_not"))
    ).select(
        "path",
        "block",
        "first_hard",
        F.max(F.greatest("last_hard", "first_hard")).over(earlier).alias("carry_hard"),
        F.max("last_head").over(earlier).alias("carry_head"),
    )
    none = F.lit(-1).cast("bigint")
    members = (
        kept.join(carried, ["path", "block"])
        .withColumn("seg", F.coalesce(F.greatest("last_hard", "first_hard", "carry_hard"), none))
        .filter(F.greatest("last_head", "carry_head") >= F.col("seg"))
        .select("path", "block", "seg", "line_no", "head", F.coalesce("text", "head").alias("text"))
    )

    shown = members if chain_chars is None else _first_chars(members, chain_chars)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "head", "text")))
    rest = F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: F.concat(F.lit("\n"), x["text"]))
    whole = F.concat(F.col("l")[0]["head"], F.array_join(rest, ""))
    chains = (
        shown.groupBy("path", "seg")
        .agg(ordered.alias("l"))
        .select("path", F.col("l")[0]["line_no"].alias("pos"), strip(head(whole, chain_chars)).alias("chain"))
    )
    return _unique_chains(chains)


def _first_chars(members: DataFrame, chars: int) -> DataFrame:
    """Lines that begin within the first ``chars`` characters of their chain.

    Later ones are dropped block by block, then with the characters of the blocks before, so a chain is gathered from few rows.
    """
    cap = F.lit(chars)
    in_part = Window.partitionBy("path", "block", "seg")
    size = F.length("text") + 1
    so_far = in_part.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        members.withColumn("part_chars", F.sum(size).over(in_part))
        .withColumn("before", F.coalesce(F.sum(size).over(so_far), F.lit(0)))
        .filter(F.col("before") < cap)
    )
    earlier = Window.partitionBy("path", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("path", "seg", "block")
        .agg(F.max("part_chars").alias("part_chars"))
        .withColumn("offset", F.coalesce(F.sum("part_chars").over(earlier), F.lit(0)))
        .filter(F.col("offset") < cap)
        .drop("part_chars")
    )
    return parts.join(offsets, ["path", "seg", "block"]).filter(F.col("offset") + F.col("before") < cap)


# --- issues -----------------------------------------------------------------------------------


def _finding(rule_id: str, severity: str, n: Column, evidence: Column) -> Column:
    return F.when(
        n > 0,
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(severity).alias("severity"),
            n.cast("bigint").alias("n"),
            evidence.alias("evidence"),
        ),
    )


def issue_findings(
    files: DataFrame, strict: bool = False, tail_chars: int | None = None, stage_matches: int | None = None
) -> DataFrame:
    """Out-of-memory, shuffle, stage, executor and skew findings with match counts, one row per file and rule.

    Stage failures show their distinct texts, those of the first ``stage_matches`` matches if that is given
    (``rules.STAGE_MATCHES`` by custom); the others are counted and show one example, the first match.
    ``strict`` keeps the narrow wording of stage failures.
    """
    text, folded = F.col("text"), F.col("folded")
    read = files.select("path", tail(F.col("content"), tail_chars).alias("text"))
    found, matches = [], []
    for severity, rule in _issue_rules(strict):
        matches.append(_rule_hits(rule, text, folded).alias(rule.rule_id))
        if rule.rule_id == "stage_failure":
            texts = F.col(rule.rule_id) if stage_matches is None else F.slice(rule.rule_id, 1, stage_matches)
            shown = F.array_join(F.array_distinct(texts), "\n")
        else:
            shown = F.get(rule.rule_id, F.lit(0))
        found.append(_finding(rule.rule_id, severity, F.size(rule.rule_id), shown))
    return (
        read.select("path", "text", F.lower("text").alias("folded"))
        .select("path", *matches)
        .select("path", F.explode(F.array_compact(F.array(*found))).alias("f"))
        .select(
            F.lit("log").alias("family"), F.col("path").alias("artifact"), "f.rule_id", "f.severity", "f.n", "f.evidence"
        )
    )


def line_hits(lines: DataFrame, strict: bool = False) -> DataFrame:
    """One row per line and rule it matches; ``signature`` shows the first 80 characters of the match.

    Columns other than ``text``, such as an event time, pass through.
    """
    text, folded = F.col("text"), F.col("folded")
    keep = [c for c in lines.columns if c != "text"]

    def hit(rule: R.Rule, severity: str) -> Column:
        return F.when(
            _rule_has(rule, text, folded),
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(severity).alias("severity"),
                first_hit(text, rule.pattern, rule.group).alias("evidence"),
            ),
        )

    rules = [hit(rule, severity) for severity, rule in _issue_rules(strict)] + [hit(_warn_rule(strict), "WARN")]
    return (
        lines.select(*keep, "text", F.lower("text").alias("folded"))
        .select(*keep, F.explode(F.array_compact(F.array(*rules))).alias("f"))
        .select(*keep, "f.rule_id", "f.severity", "f.evidence", F.left("f.evidence", F.lit(R.WARN_KEY_CHARS)).alias("signature"))
    )


def _warn_rule(strict: bool) -> R.Rule:
    return R.Rule("warn_line", R.WARN_LINE_STRICT if strict else R.WARN_LINE, 1, R.WARN_LINE_NEEDS)


def warn_lines(lines: DataFrame, strict: bool = False, first: int | None = None) -> DataFrame:
    """Distinct level lines of each path; ``line_key`` shows the first 80 characters.

    ``first`` keeps the first so many of each path, with rank and total, ``rules.WARNS_SHOWN`` by custom.
    """
    rule, text = _warn_rule(strict), F.col("text")
    unique = (
        lines.filter(_rule_has(rule, text, text))
        .select("path", "line_no", first_hit(text, rule.pattern, rule.group).alias("line"))
        .groupBy("path", "line")
        .agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_repeats"))
        .select("path", F.left("line", F.lit(R.WARN_KEY_CHARS)).alias("line_key"), "line_no", "line", "n_repeats")
    )
    return unique if first is None else first_per_path(unique, "line_no", first)


def clean_files(files: DataFrame, strict: bool = False, tail_chars: int | None = None) -> DataFrame:
    """Files with neither an issue, a level line nor an exception chain. A filter; no join is needed."""
    warn = _warn_rule(strict)
    rules = [rule for _, rule in _issue_rules(strict)] + [
        R.Rule("chain", R.JVM_HEAD, needs=R.JVM_CHAIN_NEEDS),
        warn._replace(pattern="(?m)" + warn.pattern),
    ]
    clean = let(
        tail(F.col("content"), tail_chars),
        lambda text: let(F.lower(text), lambda folded: ~_any_rule(rules, text, folded)),
    )
    return files.filter(clean).select("path")


def rollup_by_rule(line_findings: DataFrame) -> DataFrame:
    """Hits, first and last line per path and rule."""
    return line_findings.groupBy("path", "rule_id", "severity").agg(
        F.count("*").alias("n_hits"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


def top_signatures(line_findings: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent (rule, match) pairs with the number of paths they occur in."""
    return signatures(line_findings).orderBy(F.desc("n_hits"), "rule_id", "evidence").limit(k)


def heavy_signatures(line_findings: DataFrame, k: int, tracked: int = 10_000) -> DataFrame:
    """``top_signatures`` without a shuffle of every distinct pair: candidates from a mergeable summary, then exact counts of those only.

    The summary holds ``tracked`` items whatever the table. Its estimates are never too low, so a pair that is no candidate has no more hits than the
    least estimate of a candidate. Where the k-th exact count is above that, the answer is complete; otherwise more candidates are taken, and where the
    summary cannot tell any more, all pairs are counted.
    """
    hashed = line_findings.withColumn("item", F.xxhash64("rule_id", "evidence"))
    want = 4 * k
    while want <= tracked // 2:
        found = hashed.agg(F.expr(f"approx_top_k(item, {want}, {tracked})").alias("top")).first()[0] or []
        items = line_findings.sparkSession.createDataFrame([(r.item,) for r in found], "item bigint")
        some = hashed.join(F.broadcast(items), "item", "left_semi")
        exact = cut(signatures(some).orderBy(F.desc("n_hits"), "rule_id", "evidence").limit(k))
        least = min((r["count"] for r in found), default=0)
        last, n = exact.agg(F.min("n_hits"), F.count(F.lit(1))).first()
        if len(found) < want or n == k and last > least:
            return exact
        want *= 4
    return top_signatures(line_findings, k)


def signatures(line_findings: DataFrame) -> DataFrame:
    """Hits and paths of every (rule, match) pair."""
    return line_findings.groupBy("rule_id", "evidence").agg(F.count("*").alias("n_hits"), F.count_distinct("path").alias("n_paths"))


def snippet_counts(snippets: DataFrame) -> DataFrame:
    """Hits and files of every snippet of a framework, per rule."""
    return snippets.groupBy("framework", "rule_id", "snippet").agg(
        F.count("*").alias("n_hits"), F.count_distinct("path").alias("n_paths")
    )


def top_snippets(snippets: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent snippets over all files of a framework, per rule."""
    return snippet_counts(snippets).orderBy(F.desc("n_hits"), "framework", "rule_id", "snippet").limit(k)


def tail_stats(files: DataFrame, tail_chars: int = R.JVM_TAIL_CHARS) -> DataFrame:
    """The part of each file that an analysis of its recent tail reads."""
    read = files.select("path", F.length("content").cast("bigint").alias("n_chars"), tail(F.col("content"), tail_chars).alias("tail"))
    return read.select(
        "path",
        "n_chars",
        F.length("tail").cast("bigint").alias("n_tail_chars"),
        count_hits(F.col("tail"), r"\n").alias("n_tail_breaks"),
        F.md5("tail").alias("tail_md5"),
    )
