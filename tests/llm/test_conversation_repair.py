"""Conversation repair against all edits in order of cost, written from the contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from mendline.llm import conversation_repair, registry

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        role, text = role if role is not None else " ", text if text is not None else " "
        first = (role, text)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [((turn is not None, turn or 0), first, turn, role, text)] * (2 if kind == 3 else 1)
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def best(items):
    """Least (cost, audit) by trying everything; ``items``: (initial, fault)."""

    @lru_cache(None)
    def tail(i, last, inserts):
        found = [(0, "")] if i == len(items) and last in ("", "a") else []
        if i < len(items):
            initial, fault = items[i]
            found += [(c + 2, "D" + e) for c, e in tail(i + 1, last, 2)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for to in "sua":
                    ok = (last, to) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
                    if ok and to == initial:
                        found += [(c + more, "K" + e) for c, e in tail(i + 1, to, 2)]
                    if ok and to != "s":
                        found += [(c + 1 + more, "R" + e) for c, e in tail(i + 1, to, 2)]
        if inserts:
            to = "a" if last == "u" else "u"
            found += [(c + 5, "I" + e) for c, e in tail(i, to, inserts - 1)]
        return [min(found)] if found else []

    return tail(0, "", 2)[0]


def expected(rows):
    for conv, found in damage(rows).items():
        seen, items, counts = set(), [], defaultdict(int)
        for turn, role, text in found:
            last = (BLANK.findall(text) or [""])[-1]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            items.append((role[:1], fault))
        illegal = sum((a[0] + b[0]) not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        cost, audit = best(tuple(items))
        lines, at, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else found[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            lines.append(f"{role}:{text}")
        turns = {t for t, _, _ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def same(df, rows):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected(rows), key=repr)


def random_rows(seed, conversations=150):
    r = random.Random(seed)
    texts = ["Hello there.", "What?", "no end", "", None, " \t", "Yes!", "same same.", "a:b.", "line\nbreak.", "x . "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    for conv in range(conversations):
        for turn in range(r.choice([0, 1, 2, 4, 8, 12])):
            yield conv, r.choice([turn, turn, turn, turn + 1, turn * 3, None, -turn]), r.choice(roles), r.choice(texts)
    yield from [(None, 1, "user", "Null id?"), (None, None, None, None), (999, None, "user", "Only nulls."), (999, None, "assistant", "Right.")]


@pytest.mark.parametrize("seed", [1, 2])
def test_messy_conversations(spark, seed):
    rows = list(random_rows(seed))
    rows = [x for x in rows for _ in range(1 + (hash(x[:2]) % 17 == 0))]
    docs = spark.createDataFrame([(*x, "c", "p", "n", "d") for x in rows], "conv_id long, turn long, role string, text string, conv string, pos string, audit string, codes string")
    same(conversation_repair.repair(docs), rows)


def test_search_is_least():
    r = random.Random(5)
    for _ in range(3000):
        codes = "".join(chr(65 + 4 * r.choice([0, 1, 1, 2, 2, 3]) + r.choice([0, 0, 0, 1, 2, 3, 3])) for _ in range(r.randrange(11)))
        items = tuple(("sua "[(ord(c) - 65) // 4], ["", "blank", "duplicate", "truncated"][(ord(c) - 65) % 4]) for c in codes)
        assert conversation_repair.search(codes) == best(items), codes


def test_given_rows(spark):
    for sf in ("sf0.001", "sf0.01"):
        at = f"/root/testdata/{sf}"
        rows = [tuple(x) for x in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        same(registry.QUERIES["op13_conversation_repair"](spark, at), rows)


def test_repaired_turns_alternate(spark):
    rows = list(random_rows(7, 60))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = defaultdict(list)
    for x in sorted(conversation_repair.repaired(df).collect(), key=lambda x: (str(x.conv_id), x.place)):
        by[x.conv_id].append(x)
    digests = {x.conv_id: x.repaired_sha256 for x in conversation_repair.repair(df).collect()}
    for conv, digest in digests.items():
        turns = by.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in turns))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in turns).encode()).hexdigest() == digest


def test_long_conversation_and_none(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 7 else f"turn {t}") for t in range(3000)]
    row = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert re.fullmatch("[KRDI]+", row.audit) and sum(row.audit.count(x) for x in "KRD") == sum(map(len, damage(rows).values()))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair(none).collect() == [] and conversation_repair.repaired(none).collect() == []
