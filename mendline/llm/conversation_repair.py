"""Repair of the turn structure of conversations by bidirectional Dijkstra over the lattice of edits.

A node of the lattice is (rows consumed, last role so far); edits are its edges: Keep, Rerole, Delete and Insert. One heap searches from the
first node, one from the accepted last nodes. They go on until no path as cheap as the best crossing can be missing, so every crossing of
equal cost is finished; then the audit, the initials of the edits, that is least in ASCII is read off: suffixes of the nodes settled from
the end, carried back over the cheapest edges of the nodes settled from the start.

Rows are put in order once, by ranges, so that a long conversation is spread over tasks. What the search needs of a row is one letter
(initial of its role and first fault); letters are joined in pieces of bounded length, then by conversation, so a conversation reaches the
search as a string as long as its audit. The digest is of one text and takes the rows of a conversation in order, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendline.llm.common import cut, narrow, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
_PIECE_BITS = 10
#: Last role: none, system, user, assistant. What may follow, by initial.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_GROWS = {0: 2, 1: 2, 2: 3, 3: 2}  # by an inserted or rerolled turn: user, but assistant after user
_ACCEPTED = (0, 3)
_LEGAL = {"su", "ua", "au"}
_FAR = 1 << 60


def _row(code: str) -> tuple[str, int]:
    """Initial of the role and first fault (0 none, 1 blank, 2 duplicate, 3 truncated) that a letter stands for."""
    kind, fault = divmod(ord(code) - 65, 4)
    return "sua"[kind] if kind < 3 else "x", fault


def _edges(rows: list[tuple[str, int]], i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, rows consumed, last role) of every edge out of a node."""
    if i < len(rows):
        initial, fault = rows[i]
        yield "D", DELETE, i + 1, q
        if fault in (0, 3):
            more = TRUNCATED if fault else 0
            if q in _NEXT.get(initial, ()):
                yield "K", more, i + 1, _NEXT[initial][q]
            yield "R", REROLE + more, i + 1, _GROWS[q]
    yield "I", INSERT, i, _GROWS[q]


_PRIOR = {r: [q for q in _GROWS if _GROWS[q] == r] for r in range(4)}


def _back(rows: list[tuple[str, int]], j: int, r: int) -> Iterator[tuple[int, int, int]]:
    """(cost, rows consumed, last role) of every edge into a node, from its other end."""
    if j:
        initial, fault = rows[j - 1]
        yield DELETE, j - 1, r
        if fault in (0, 3):
            more = TRUNCATED if fault else 0
            for q, to in _NEXT.get(initial, {}).items():
                if to == r:
                    yield more, j - 1, q
            for q in _PRIOR[r]:
                yield REROLE + more, j - 1, q
    for q in _PRIOR[r]:
        yield INSERT, j, q


def search(codes: str) -> tuple[int, str]:
    """Least cost of the rows ``codes``, and the least audit of that cost."""
    rows = [_row(c) for c in codes]
    n = len(rows)
    size = 4 * (n + 1)
    dist = ([_FAR] * size, [_FAR] * size)
    done = (bytearray(size), bytearray(size))
    heaps: tuple[list, list] = ([(0, 0, 0)], [(0, -n, q) for q in _ACCEPTED])
    dist[0][0] = 0
    for q in _ACCEPTED:
        dist[1][4 * n + q] = 0
    heapq.heapify(heaps[1])
    best = dist[1][0]  # of crossings so far; without rows the first node is accepted
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        d, at, q = heapq.heappop(heaps[side])
        at = abs(at)
        node = 4 * at + q
        if done[side][node]:
            continue
        done[side][node] = 1
        for cost, i, p in ((e[1], e[2], e[3]) for e in _edges(rows, at, q)) if not side else _back(rows, at, q):
            to = 4 * i + p
            if d + cost < dist[side][to]:
                dist[side][to] = d + cost
                heapq.heappush(heaps[side], (d + cost, -i if side else i, p))
                best = min(best, dist[0][to] + dist[1][to])
    return best, _least_audit(rows, dist, done, best)


def _least_audit(rows: list[tuple[str, int]], dist, done, best: int) -> str:
    """The least audit over all cheapest paths; a path is kept as the edit and the node after it, and two are compared up to where they meet."""
    (ahead, behind), n = dist, len(rows)
    step: dict[int, tuple[str, int]] = {}
    ends = {4 * n + q for q in _ACCEPTED}

    def less(a: tuple[str, int], b: tuple[str, int]) -> bool:
        while a != b:
            if a[0] != b[0]:
                return a[0] < b[0]
            if a[1] in ends or b[1] in ends:
                return a[1] in ends
            a, b = step[a[1]], step[b[1]]
        return False

    def choose(node: int, fits) -> None:
        for edit, cost, i, q in _edges(rows, *divmod(node, 4)):
            if fits(cost, to := 4 * i + q) and (node not in step or less((edit, to), step[node])):
                step[node] = (edit, to)

    # An edge costs something or consumes a row, so in this order every node comes after those that its cheapest edges lead to.
    for node in sorted((v for v in range(len(behind)) if done[1][v]), key=lambda v: (behind[v], -(v >> 2))):
        if node not in ends:
            choose(node, lambda cost, to: done[1][to] and cost + behind[to] == behind[node])
    crossed = lambda v: done[1][v] and ahead[v] + behind[v] == best
    reached = {v for v in ends if ahead[v] == best}
    for node in sorted((v for v in range(len(ahead)) if done[0][v]), key=lambda v: (ahead[v], v >> 2), reverse=True):
        if crossed(node):
            reached.add(node)
        elif node not in ends:
            step.pop(node, None)
            choose(
                node,
                lambda cost, to: done[1][to] and ahead[node] + cost + behind[to] == best
                or to in reached and ahead[node] + cost == ahead[to],
            )
            if node in step:
                reached.add(node)
    out, node = [], 0
    while node not in ends:
        edit, node = step[node]
        out.append(edit)
    return "".join(out)


@lru_cache(1 << 14)
def judged(codes: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal, cost, audit of the rows ``codes``."""
    rows = [_row(c) for c in codes]
    faults = [f for _, f in rows]
    illegal = sum(a[0] + b[0] not in _LEGAL for a, b in zip(rows, rows[1:]))
    return (*(faults.count(f) for f in (1, 2, 3)), illegal, *search(codes))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, first_role, first_text, copy, dropped) of every row after damage; what is dropped is marked.

    conv tells conversations apart, null ids among them. Null roles and texts are one space, and so is a null id or turn in the key.
    """
    c = narrow(conversations, "conv_id", "turn", "role", "text")
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = c.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        blank("role").alias("first_role"),
        blank("text").alias("first_text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("first_text", ".!?", "")).otherwise(F.col("first_text"))
    return rows.select(
        "conv",
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("first_role")).alias("role"),
        text.alias("text"),
        "first_role",
        "first_text",
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("kind") == 0).alias("dropped"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, pos): pos grows in the order of a conversation. Equal turns go by role and text before damage."""
    here = rows.filter("not dropped").repartitionByRange("conv", F.col("turn").asc_nulls_first(), "first_role")
    here = here.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "first_role", "first_text", "copy")
    return cut(here.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")))


def _letters(ordered: DataFrame) -> DataFrame:
    """(conv, codes): a letter for each row of a conversation."""
    # White space is that of the word contract; the last other sign decides.
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), -1, 1)
    rows = ordered.select("conv", "pos", "role", F.md5(F.col("text").cast("binary")).alias("digest"), last.alias("last"))
    again = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = rows.join(again, ["conv", "role", "digest"], "left")
    fault = (
        F.when(F.col("last") == "", 1).when(F.col("pos") > F.col("first"), 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.char(F.lit(65) + 4 * kind + fault)
    pieces = met.select("conv", F.shiftright("pos", _PIECE_BITS).alias("piece"), F.struct("pos", code.alias("code")).alias("x"))
    joined = lambda column, field: F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x[field]), "")
    some = pieces.groupBy("conv", "piece").agg(joined("x", "code").alias("codes"))  # 1024 rows at most
    return some.groupBy("conv").agg(joined(F.struct("piece", "codes"), "codes").alias("codes"))


def _audits(letters: DataFrame) -> DataFrame:
    names = ("blank", "duplicate", "truncated", "illegal", "cost", "audit")
    kinds = (pa.int64(),) * 5 + (pa.string(),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judged(c) for c in b.column(1).to_pylist()]
            columns = zip(*found) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds))], names=["conv", *names]
            )

    return letters.mapInArrow(run, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text); ``rows`` are those of the conversation in order."""
    last = 0
    for edit in audit:
        role, text = ("user", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        last_role = {"s": 1, "u": 2, "a": 3}[role[0]] if edit == "K" else _GROWS[last]
        if edit != "K":
            role = "user" if last_role == 2 else "assistant"
        last = last_role
        yield role, text


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, Iterator[tuple[str, str]]]]:
    """(conv, audit, its rows) of every conversation; the rows must be used up before the next one."""
    flat = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)))
    ahead = next(flat, None)

    def rows(conv: str) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            yield ahead[2].as_py(), ahead[3].as_py()
            ahead = next(flat, None)

    while ahead is not None:
        conv, pos, _, audit = ahead
        if pos != -1:
            raise RuntimeError(f"conversation {conv} has no audit before its rows")
        ahead = next(flat, None)
        yield conv, audit.as_py(), rows(conv)


def _in_order(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, pos, role, text): every conversation's audit, then its rows."""
    heads = audits.select("conv", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = ordered.select("conv", "pos", "role", "text").unionByName(heads)
    return both.repartition("conv").sortWithinPartitions("conv", "pos")


def _digests(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs, digests = [], []
        for conv, audit, rows in _streamed(batches):
            digest, first = hashlib.sha256(), True
            for role, text in repaired_turns(audit, rows):
                line = f"{role}:{text}" if first else f"\n{role}:{text}"
                digest.update(line.encode("utf-8", "surrogatepass"))
                first = False
            for _ in rows:
                pass
            convs.append(conv)
            digests.append(digest.hexdigest())
            if len(convs) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(convs), pa.array(digests)], names=["conv", "repaired_sha256"])
                convs, digests = [], []
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(digests, pa.string())], names=["conv", "repaired_sha256"])

    return _in_order(ordered, audits).mapInArrow(run, "conv string, repaired_sha256 string")


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    ordered = _ordered(rows)
    return ordered, cut(_audits(_letters(ordered)))


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns of every damaged and repaired conversation, numbered from 1; see ``repair``."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    ordered, audits = _found(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = ["conv", "place", "role", "text"], [], 0
        for conv, audit, own in _streamed(batches):
            for place, (role, text) in enumerate(repaired_turns(audit, own), 1):
                held.append((conv, place, role, text))
                size += len(text)
                if len(held) == 2000 or size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=names)
                    held, size = [], 0
            for _ in own:
                pass
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held)], names=names)

    turns = _in_order(ordered, audits).mapInArrow(run, "conv string, place long, role string, text string")
    return turns.join(ids, "conv").select("conv_id", "place", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conv_id of ``conversations``.

    Rows are damaged (``damaged``) and then judged and repaired in the order of their turns, null turns first, equal turns by role and text.
    Null ids are one conversation. Empty texts are blank. Repeated rows are duplicates. A role that begins with none of s, u and a can
    only be rerolled or deleted. A conversation without rows after damage has zeros, an empty audit and the digest of the empty text. No
    rows give no rows.
    """
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    ordered, audits = _found(rows)
    spans = ordered.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    out = ids.join(audits, "conv", "left").join(spans, "conv", "left").join(_digests(ordered, audits), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id",
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
