"""Conversation repair against a search over all edits and a plain dynamic program."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tripsearch.llm import repair

SPACES = " \t\n\x0b\x0c\r"


def after_damage(rows):
    """{conv_id: rows in order}; a conversation that lost all has none."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv] += []
        show = lambda x: " " if x is None else str(x)
        c = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if c == 1:
            text = ""
        if c == 2:
            text = "".join(x for x in text if x not in ".!?")
        if c == 4:
            role = "user"
        if c:
            out[conv] += [(turn, role, text)] * (2 if c == 3 else 1)
    mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, mark(r))) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


STEP = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def plain(rows):
    kinds = faults(rows)
    best = {"": (0, "", ())}  # by the last initial: cost, audit, repaired rows

    def keep(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, said) in list(table.items()):
                for x in "ua":
                    if x in STEP[state]:
                        keep(table, x, (cost + 5, audit + "I", (*said, f"{FULL[x]}:")))
        return table

    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit, said) in inserted(best).items():
            keep(after, state, (cost + 2, audit + "D", said))
            if kind in ("", "truncated"):
                cost += 5 * (kind == "truncated")
                if role[:1] in STEP[state] and role[:1]:
                    keep(after, role[0], (cost, audit + "K", (*said, f"{role}:{text}")))
                for x in "ua":
                    if x in STEP[state]:
                        keep(after, x, (cost + 1, audit + "R", (*said, f"{FULL[x]}:{text}")))
        best = after
    cost, audit, said = min(v for k, v in inserted(best).items() if k in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(), len(rows),
    )


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, block long, word string, conv string")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(table.repartition(3)).collect()}
    want = {k: plain(v) for k, v in after_damage(rows).items()}
    assert got == want
    return got


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "cut", "  ", "", None, "Why? ", "end.\n", "…", "é."]
    for conv in convs:
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            yield conv, rng.choice([turn, turn, turn, turn + 3, None]) if conv is None or conv % 3 == 0 else turn, role, rng.choice(texts) if rng.random() < 0.4 else f"{conv} {turn}."


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = [*random_rows(rng, [*range(300), None], 14)]
    rows += [r for r in rows if rng.random() < 0.1]
    got = check(spark, rows)
    assert {x for r in got.values() for x in r[6]} >= set("KRD")


@pytest.mark.parametrize("fan", [2, 64])
def test_long_conversations(spark, monkeypatch, fan):
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(12)
    rows = [*random_rows(rng, [*range(6)], 30)]
    for conv in (100, 101, None):
        rows += [(conv, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"{t}.", f"{t}"])) for t in range(700)]
    check(spark, rows)


def test_a_conversation_that_loses_all_its_rows(spark):
    rows = [(c, 0, "user", "Hi.") for c in range(60)]
    got = check(spark, rows)
    assert any(r == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0) for r in got.values())


def test_empty_table(spark):
    assert repair.repair_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rules_change_no_matrix():
    """Products of letters one by one and by named pairs agree in costs and audits."""
    rng = random.Random(3)
    plain_one, named = repair.Grammar(), repair.Grammar()
    named.add([(1, 2), (4, 5)])
    named.add([(10, 10), (11, 8)])
    named.add([(12, 10)])
    shown = lambda m: [[e and (e[0], repair.flat(e[1])) for e in row] for row in m]
    for _ in range(60):
        word = "".join(rng.choice(repair.LETTERS + "ua" * 8) for _ in range(rng.randrange(1, 40)))
        assert shown(plain_one.matrix(word)) == shown(named.matrix(word))
    assert len(named.parse("uaua" * 8)) < 17
