from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from decoyscope.llm import conversations

DDL = "conv_id long, turn long, role string, text string"


def damage(rows):
    out, ids = defaultdict(list), set()
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        ids.add(conv)
        kind = crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, text)
        out[conv] += [row] * {0: 0, 3: 2}.get(kind, 1)
    return ids, {conv: sorted(rows) for conv, rows in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        spoken = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def applied(rows, audit):
    """The repaired turns if this audit of initials is a legal one, else None."""
    out, left = [], list(rows)
    user = True
    for edit in audit:
        if edit == "I":
            out.append(("user" if user else "assistant", ""))
            user = not user
            continue
        (_, _, role, text), fault = left.pop(0)
        if edit == "D":
            continue
        if fault in ("blank", "duplicate"):
            return None
        if edit == "K" and role[:1] == "s":
            if out:
                return None
            out.append((role, text))
            continue
        if edit == "K" and role[:1] != ("u" if user else "a"):
            return None
        out.append((("user" if user else "assistant") if edit == "R" else role, text))
        user = not user
    initials = "".join(role[:1] for role, _ in out)
    return out if not left and re.fullmatch("(s?(ua)+)?", initials) else None


def price(rows, audit):
    total, left = 0, list(rows)
    for edit in audit:
        fault = left.pop(0)[1] if edit != "I" else ""
        total += {"K": 0, "R": 2, "D": 3, "I": 2}[edit] + (edit in "KR" and fault == "truncated")
    return total


def exhaustive(rows):
    """The best of all audits with at most two inserts in a gap."""
    gaps = itertools.product(["", "I", "II"], repeat=len(rows) + 1)
    best = None
    for inserts in gaps:
        for edits in itertools.product("KRD", repeat=len(rows)):
            audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:]))
            if applied(rows, audit) is not None:
                best = min(best or (10**9, ""), (price(rows, audit), audit))
    return best


def stepwise(rows):
    """The same by whole strings: state -> (cost, audit); the state is the last initial that stays."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, text) in list(best.items()):
                for role in follows[state]:
                    if role != "s":
                        best[role] = min(best.get(role, (10**9, "")), (cost + 2, text + "I"))
        return best

    best = {"": (0, "")}
    for (_, _, role, _), fault in rows:
        after = {}
        for state, (cost, text) in inserted(best).items():
            offers = [(state, cost + 3, "D")]
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                offers += [(r, cost + 2 + extra, "R") for r in follows[state] if r != "s"]
                if role[:1] and role[:1] in follows[state]:
                    offers.append((role[:1], cost + extra, "K"))
            for new, price_, edit in offers:
                after[new] = min(after.get(new, (10**9, "")), (price_, text + edit))
        best = after
    return min(inserted(best)[state] for state in ("", "a") if state in best)


def brute(rows, solve=stepwise):
    ids, after = damage(rows)
    out = {}
    for conv in ids:
        own = after.get(conv, [])
        found = faults(own)
        pairs = list(zip(own, found))
        cost, audit = solve(pairs)
        turns = {t for known, t, _, _ in own if known}
        initials = [r[:1] for _, _, r, _ in own]
        text = "\n".join(f"{r}:{t}" for r, t in applied(pairs, audit))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def run(df, block=conversations.BLOCK):
    rows = conversations.report(df, block).collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def some_rows(chance, conversations_, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "superuser"]
    texts = ["Hello there.", "What now?", "No end", "", "  \t", None, "Fine!\n", "twice. twice", "Ünïcode… no", "x"]
    rows = []
    for conv in conversations_:
        for turn in range(chance.randint(1, longest)):
            text = chance.choice(texts) if chance.random() < 0.4 else f"Text {chance.randrange(10**6)}{chance.choice(['.', '?', '', ' '])}"
            rows.append((conv, None if chance.random() < 0.05 else turn * chance.choice([1, 1, 1, 2]), chance.choice(roles), text))
    return rows


def test_reports_equal_exhaustive_search(spark):
    rows = some_rows(random.Random(2), range(60), 4)
    assert run(spark.createDataFrame(rows, DDL)) == brute(rows, exhaustive)


@pytest.mark.parametrize("block", [3, 2048])
def test_reports_equal_whole_string_program(spark, block):
    chance = random.Random(3)
    rows = some_rows(chance, [*range(60), None], 30) + some_rows(chance, [1000], 900)
    rows += [rows[0], rows[1]] * 3 + [(2000, 5, "user", "Same again.")] * 40
    rows += [(3000, None, None, None), (3001, 1, "user", ""), (3002, None, "system", "Only me.")]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, DDL).withColumns({"mark": F.lit("clash"), "n": F.lit(3), "audit": F.lit("K"), "conv": F.lit(1)})
    assert run(df.repartition(5), block) == brute(rows)


def test_long_text_and_empty_table(spark):
    rows = [(1, 1, "user", "word " * 200_000 + "."), (1, 2, "assistant", " " * 100_000 + "Yes.")]
    assert run(spark.createDataFrame(rows, DDL)) == brute(rows)
    assert run(spark.createDataFrame([], DDL)) == {}


def test_repaired_turns(spark):
    rows = some_rows(random.Random(5), range(40), 12)
    damaged = conversations.damaged(spark.createDataFrame(rows, DDL))
    turns = conversations.repaired(damaged, conversations.audits(damaged)).collect()
    by_conv = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r.conv_text, r.place)):
        by_conv[int(r.conv_text)].append(f"{r.role}:{r.text}")
    for conv, row in brute(rows).items():
        assert hashlib.sha256("\n".join(by_conv[conv]).encode()).hexdigest() == row[-1]


@pytest.mark.parametrize("prime", [conversations.Prefixes.PRIME, 1, 3])
def test_prefix_order_with_and_without_collisions(monkeypatch, prime):
    monkeypatch.setattr(conversations.Prefixes, "PRIME", prime)
    chance, nodes = random.Random(7), conversations.Prefixes()
    known = [0]
    for _ in range(400):
        known.append(nodes.then(chance.choice(known[-30:]), chance.choice("DIKR"[:2])))
    for _ in range(3000):
        a, b = chance.choice(known), chance.choice(known)
        assert nodes.before(a, b) == (nodes.string(a) < nodes.string(b))
