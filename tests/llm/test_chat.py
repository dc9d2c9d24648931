import random
from collections import Counter

import pytest
from oracle import compare, connect

from cmdprism.llm import chat
from cmdprism.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, part int"


def brute(rows):
    """Kept conversations: id, snapshots, messages."""
    held = {}
    for conv, turn, role, text, _ in rows:
        held.setdefault(conv, set()).add((turn, role, text))

    def key(m):
        return tuple((x is not None, x if x is not None else "") if i else (x is not None, x or 0) for i, x in enumerate(m))

    turns = {}
    for conv, messages in held.items():
        by_turn = {}
        for m in messages:
            by_turn.setdefault(m[0], set()).add(m)
        turns[conv] = tuple(frozenset(by_turn[t]) for t in sorted(by_turn, key=lambda t: (t is not None, t or 0)))
    out = []
    for whole in set(turns.values()):
        if any(len(other) > len(whole) and other[: len(whole)] == whole for other in turns.values()):
            continue
        same = [c for c, t in turns.items() if t == whole]
        known = [c for c in same if c is not None]
        kept = min(known) if known else None
        out.append((kept, len(same), sorted(held[kept], key=key)))
    return out


def made_up():
    rng = random.Random(6)
    rows, conv = [], 0
    for _ in range(25):
        talk = [(t, ["user", "assistant"][t % 2], f"say {rng.randrange(6)}") for t in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(1, 5)):
            conv += 1
            rows += [(conv, *m, 1) for m in talk[: rng.randrange(1, len(talk) + 1)]]
    rows += [(500, t, "user", "x" * (t % 7), 1) for t in range(1300)]  # over several parts
    rows += [(501, t, "user", "x" * (t % 7), 1) for t in range(1100)]
    rows += [(502, t, "user", "x" * (t % 7), 1) for t in range(1300)]
    rows += [(600, 0, None, None, 1), (601, 0, "", "", 1), (602, None, "user", "a", 1), (602, 0, "user", "b", 1), (603, None, "user", "a", 1)]
    rows += [(None, 0, "user", "nobody", 1), (None, 1, "user", "else", 1), (604, 0, "user", "nobody", 1), (605, 3, "user", "two", 1)]
    rows += [(605, 3, "assistant", "at once", 1), (606, 0, "user", "y" * 200_000, 1)]
    rows += rows[:40]  # repeated rows
    rng.shuffle(rows)
    return rows


def test_kept_conversations_equal_brute_force(spark):
    rows = made_up()
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["conv_id"], []).append(r)
    want = {conv: (n, messages) for conv, n, messages in brute(rows)}
    assert set(parts) == set(want)
    for conv, (n, messages) in want.items():
        mine = sorted(parts[conv], key=lambda r: r["part"])
        assert {r["snapshots"] for r in mine} == {n}
        assert sum(r["n_messages"] for r in mine) == len(messages)
        assert "".join(r["rendered"] for r in mine) == "".join(f"<|{role or ''}|>\n{text or ''}\n" for _, role, text in messages)
    assert len(parts[500]) == 3


def test_parts_are_bounded_whatever_the_turns_are(spark):
    rng = random.Random(7)
    rows = [(None, None, "user", f"lost {i} " + "x" * rng.randrange(200), 1) for i in range(3000)]
    rows += [(1, rng.randrange(2), rng.choice(["user", None]), f"say {i} " + "y" * rng.randrange(200), 1) for i in range(3000)]
    rows += [(1, 600, "user", "later", 1), (1, 1200, "user", None, 1), (2, 0, "user", "short", 1), (2, 700, "user", "end", 1)]
    rows += [(3, 0, "user", "one\n" * 20_000, 1), (3, 1, "user", "after a long one", 1)]
    rows += [(4, 0, "user", "again", 1)] * 2000  # one message
    rows += rows[:500]
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA), part_bytes=20_000).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["conv_id"], []).append(r)
        assert r["n_messages"] == 1 or len(r["rendered"]) <= 20_000 + 300
        assert r["n_messages"] <= 20_000 // chat.MESSAGE_BYTES + 1
    for conv, n, messages in brute(rows):
        mine = sorted(parts.pop(conv), key=lambda r: r["part"])
        assert len({r["part"] for r in mine}) == len(mine) and {r["snapshots"] for r in mine} == {n}
        assert sum(r["n_messages"] for r in mine) == len(messages)
        assert "".join(r["rendered"] for r in mine) == "".join(f"<|{role or ''}|>\n{text or ''}\n" for _, role, text in messages)
    assert not parts
    assert [r["part"] for r in got if r["conv_id"] == 2] in ([0, 1], [1, 0]) and [r["part"] for r in got if r["conv_id"] == 4] == [0]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    seen = []
    name = "op2_chat_snapshots"
    assert compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir, seen.append) is None
    plan = seen[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert Counter(type(r["n_messages"]) for r in seen[0].take(3)) == {int: 3}


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
