"""Role repair against all ways, over blocks of any size, and the rendered text."""

import itertools
import random
import re

import pytest
from voxloom.llm import chat as C

TURNS = "conv_id long, turn long, role string, text string"


def cost(roles, states):
    total, state = 0, C.START
    for role, after in zip(roles, states):
        total += int(C.COSTS[role][state][after])
        state = after
    return total + int(C.END_COSTS[state])


def test_least_cost_of_all_ways():
    draw = random.Random(1)
    for _ in range(150):
        roles = [draw.randrange(4) for _ in range(draw.randrange(1, 7))]
        best = min(cost(roles, w) for w in itertools.product((1, 2, 3), repeat=len(roles)))
        assert cost(roles, C.solve(roles, C.START, C.END_COSTS)) == best


def legal(rendered):
    state = C.START
    for name in re.findall(r"<\|(system|user|assistant)\|>\n", rendered):
        role = C.ROLES.index(name) + 1
        assert role in C.FOLLOWERS[state]
        state = role
    assert state == 3
    assert rendered.count("<|end|>") == len(re.findall(r"<\|(?:system|user|assistant)\|>", rendered))


@pytest.mark.parametrize("block", [3, 512])
def test_blocks_give_what_one_walk_gives(spark, monkeypatch, block):
    draw = random.Random(4)
    names = ["user", "assistant", "System", None, "bot", " USER "]
    rows = [(7, i, draw.choice(names), f"t{i} <|end|>") for i in range(60)]
    rows += [(c, t, draw.choice(names), f"c{c}t{t}") for c in range(8, 14) for t in range(c - 7)]
    rows += [(None, None, "user", None), (None, 1, "user", "a"), (None, 1, "user", "a")]
    monkeypatch.setattr(C, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", action string")
    got = C.repair_roles(df).collect()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        low = (lambda x: (x is not None, x if x is not None else 0))
        own.sort(key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        roles = [C.role_number(r[2]) for r in own]
        states = C.solve(roles, C.START, C.END_COSTS)
        mine = [r for r in got if r["conv_id"] == conv]
        want, state = [], C.START
        for i, (r, role, after) in enumerate(zip(own, roles, states)):
            action, piece, added = C.render(state, after, role, r[3], i == len(own) - 1)
            want.append((conv, r[1], r[2], C.ROLES[after - 1], action, added, piece))
            state = after
        assert sorted(map(tuple, mine), key=repr) == sorted(want, key=repr)
        legal("".join(w[-1] for w in want))


def test_legal_conversations_stay_and_empty_tables(spark, folder):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = C.repair_roles(spark.createDataFrame(rows, TURNS)).orderBy("turn").collect()
    assert [r["action"] for r in got] == ["keep"] * 3
    assert "".join(r["rendered"] for r in got) == (
        "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"
    )
    assert C.repair_roles(spark.createDataFrame([], TURNS)).count() == 0
