"""Chat formatting with role repair of least cost.

A legal conversation may start with a system turn, then user and assistant alternate, and
it ends with the assistant. Every turn of the input is kept: a turn is emitted under its
role or another one, or merged into the turn before, and empty turns are inserted where
the automaton needs one. Dynamic programming over the automaton picks the cheapest way.

A turn is a 4 x 4 matrix of costs (state before, state after), and a run of turns is their
product with + for times and min for plus. So rows in order of conversation and turn are
cut into blocks of bounded size whatever conversation they belong to; a conversation that
crosses blocks is joined by a scan over its few matrices, itself in blocks; and each block
then solves its own turns from the state it starts in. No task holds a whole conversation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.columns import number_all
from voxloom.session import cut_lineage

ROLES = ("system", "user", "assistant")
START = 0
MERGE, RELABEL, INSERT = 1, 2, 3
BLOCK = 512
FAR = 1 << 40

# After a state (0: nothing yet, then the roles in order), the roles that may follow.
FOLLOWERS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def _inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns that lead from a state to where ``role`` may follow."""
    if role in FOLLOWERS[state]:
        return ()
    for between in FOLLOWERS[state]:
        if role in FOLLOWERS[between]:
            return (between,)
    return None


def _step(role: int, state: int, after: int) -> tuple[int, str, tuple[int, ...]]:
    """Cost, action and inserted turns of taking a turn of ``role`` (0: unknown)."""
    relabel = 0 if role == after else RELABEL
    best = (FAR, "none", ())
    if after == START:
        return best
    between = _inserted(state, after)
    if between is not None:
        action = "relabel" if relabel else "keep"
        best = (relabel + INSERT * len(between), action, between)
    if state == after and MERGE + relabel < best[0]:
        best = (MERGE + relabel, "merge", ())
    return best


STEPS = [[[_step(r, s, t) for t in range(4)] for s in range(4)] for r in range(4)]
COSTS = np.array([[[STEPS[r][s][t][0] for t in range(4)] for s in range(4)] for r in range(4)])
# Empty turns after the last one: the assistant has the last word.
ENDINGS = {0: (), 1: (2, 3), 2: (3,), 3: ()}
END_COSTS = np.array([INSERT * len(ENDINGS[s]) for s in range(4)])


def role_number(role: str | None) -> int:
    """1 to 3 for system, user and assistant in any case; 0 for null and others."""
    name = (role or "").strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) + 1 if name in ROLES else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def run_matrix(roles: list[int]) -> np.ndarray:
    out = COSTS[roles[0]]
    for role in roles[1:]:
        out = product(out, COSTS[role])
    return out


def solve(roles: list[int], state: int, final: np.ndarray) -> list[int]:
    """The state after each turn on a cheapest way; ties go to the smallest state."""
    costs = [np.asarray(final)]
    for role in reversed(roles):
        costs.append(np.minimum((COSTS[role] + costs[-1][None, :]).min(axis=1), FAR))
    costs.reverse()
    out = []
    for role, rest in zip(roles, costs[1:]):
        state = int(np.argmin(COSTS[role][state] + rest))
        out.append(state)
    return out


def _clean(text: str | None) -> str:
    """A text can't hold a mark of the format: ``<|`` becomes ``< |``."""
    return text.replace("<|", "< |") if isinstance(text, str) else ""


def render(state: int, after: int, role: int, text: str | None, last: bool) -> tuple[str, str, int]:
    """Action, rendered piece and number of inserted turns of one input turn.

    The pieces of a conversation joined in order are the rendered conversation.
    """
    _, action, between = STEPS[role][state][after]
    if action == "merge":
        piece = "\n" + _clean(text)
    else:
        close = "" if state == START else "<|end|>\n"
        empty = "".join(f"<|{ROLES[b - 1]}|>\n<|end|>\n" for b in between)
        piece = f"{close}{empty}<|{ROLES[after - 1]}|>\n{_clean(text)}"
    added = len(between)
    if last:
        piece += "<|end|>\n" + "".join(f"<|{ROLES[b - 1]}|>\n<|end|>\n" for b in ENDINGS[after])
        added += len(ENDINGS[after])
    return action, piece, added


def _numbers(column: pd.Series) -> list[np.ndarray]:
    return [np.array(m, dtype=np.int64) for m in column]


def _scan(
    pieces: DataFrame,
    joined: Callable[[list[np.ndarray]], np.ndarray],
    passed: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]],
    first: list[int],
) -> DataFrame:
    """``conv, k, value``: a running value along the pieces ``conv, k, m`` of each ``conv``.

    ``joined`` makes one piece of several, ``passed`` gives the value of each of several
    pieces from the value that enters them, which is ``first`` for a whole conversation.
    """
    pieces = cut_lineage(pieces)
    largest = pieces.agg(F.max("k")).first()[0]
    if largest is None or largest < BLOCK:
        entered = pieces.withColumn("group", F.lit(0)).withColumn(
            "enters", F.array(*[F.lit(v).cast("long") for v in first])
        )
    else:

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("k")
            whole = joined(_numbers(pdf["m"])).ravel().tolist()
            return pdf.head(1)[["conv", "group"]].assign(m=[whole])

        grouped = pieces.withColumn("group", F.floor(F.col("k") / BLOCK))
        parents = grouped.groupBy("conv", "group").applyInPandas(
            together, "conv long, group long, m array<long>"
        )
        above = _scan(parents.withColumnRenamed("group", "k"), joined, passed, first)
        above = above.select("conv", F.col("k").alias("group"), F.col("value").alias("enters"))
        entered = grouped.join(above, ["conv", "group"])

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        values = passed(_numbers(pdf["m"]), np.array(pdf["enters"].iloc[0], dtype=np.int64))
        return pdf[["conv", "k"]].assign(value=[v.tolist() for v in values])

    return cut_lineage(
        entered.groupBy("conv", "group").applyInPandas(along, "conv long, k long, value array<long>")
    )


def _square(m: np.ndarray) -> np.ndarray:
    return m.reshape(4, 4)


def _join_costs(several: list[np.ndarray]) -> np.ndarray:
    out = _square(several[0])
    for m in several[1:]:
        out = product(out, _square(m))
    return out


def _costs_after(several: list[np.ndarray], enters: np.ndarray) -> list[np.ndarray]:
    """The cost from the end of each piece to the end of the conversation, by state."""
    out, rest = [], enters
    for m in reversed(several):
        out.append(rest)
        rest = np.minimum((_square(m) + rest[None, :]).min(axis=1), FAR)
    return out[::-1]


def _join_moves(several: list[np.ndarray]) -> np.ndarray:
    out = several[0]
    for m in several[1:]:
        out = m[out]
    return out


def _states_before(several: list[np.ndarray], enters: np.ndarray) -> list[np.ndarray]:
    out, state = [], enters
    for m in several:
        out.append(state)
        state = m[state]
    return out


def repair_roles(turns: DataFrame) -> DataFrame:
    """Every turn of ``conv_id, turn, role, text`` with what becomes of it.

    Columns: ``conv_id, turn, role, new_role, action`` (keep, relabel or merge),
    ``inserted`` (empty turns added before it, and after it if it is the last) and
    ``rendered``, its piece of the formatted conversation. Turns go by ``turn`` (null
    first), equal ones by role and text; a null ``conv_id`` is a conversation like others;
    a null text is empty; a null or unknown role is relabelled; rows that repeat are turns
    of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    turn_type = rows.schema["turn"].dataType.simpleString()
    # A conversation is known by the place of its first turn.
    placed = cut_lineage(number_all(rows, order, "_place"))
    firsts = placed.groupBy("conv_id").agg(
        F.min("_place").alias("conv"), F.max("_place").alias("_last")
    )
    firsts = firsts.withColumnRenamed("conv_id", "_id")
    known = cut_lineage(
        placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_id")))
        .withColumn("block", F.floor(F.col("_place") / BLOCK))
        .drop("_id")
    )

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, part in pdf.sort_values("_place").groupby("conv"):
            crosses = part["_place"].iloc[0] > conv or part["_place"].iloc[-1] < part["_last"].iloc[0]
            if crosses:
                m = run_matrix([role_number(r) for r in part["role"]])
                out.append((conv, pdf["block"].iloc[0], m.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv", "block", "m"])

    crossing = cut_lineage(
        known.select("conv", "block", "_place", "_last", "role")
        .groupBy("block")
        .applyInPandas(matrices, "conv long, block long, m array<long>")
        .withColumn("k", F.col("block") - F.floor(F.col("conv") / BLOCK))
    )
    after = _scan(crossing.select("conv", "k", "m"), _join_costs, _costs_after, END_COSTS.tolist())
    weighed = crossing.join(after, ["conv", "k"])

    def moves(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (conv, k), part in pdf.sort_values("_place").groupby(["conv", "k"]):
            roles, rest = [role_number(r) for r in part["role"]], np.array(part["value"].iloc[0])
            # The same walk as the one that solves the block, so ties fall alike.
            out.append((conv, k, [solve(roles, s, rest)[-1] for s in range(4)]))
        return pd.DataFrame(out, columns=["conv", "k", "m"])

    chosen = (
        known.select("conv", "block", "_place", "role")
        .join(weighed.select("conv", "block", "k", "value"), ["conv", "block"])
        .groupBy("block")
        .applyInPandas(moves, "conv long, k long, m array<long>")
    )
    before = _scan(chosen, _join_moves, _states_before, [START])
    bounds = weighed.select("conv", "k", "block", F.col("value").alias("rest")).join(
        before.select("conv", "k", F.col("value").alias("enters")), ["conv", "k"]
    )
    bounds = bounds.select(
        "conv", "block", "rest", F.element_at("enters", 1).alias("state")
    )
    solved_type = (
        f"conv_id {conv_type}, turn {turn_type}, role string, new_role string, action string, "
        "inserted int, rendered string"
    )

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place").reset_index(drop=True)
        new, actions, pieces, inserted = [], [], [], []
        for _, part in pdf.groupby("conv", sort=True):
            roles = [role_number(r) for r in part["role"]]
            rest, state = part["rest"].iloc[0], part["state"].iloc[0]
            rest = END_COSTS if rest is None else np.array(rest)
            state = START if pd.isna(state) else int(state)
            states = solve(roles, state, rest)
            is_last = (part["_place"] == part["_last"]).tolist()
            for role, to, text, last in zip(roles, states, part["text"], is_last):
                action, piece, added = render(state, to, role, text, last)
                new.append(ROLES[to - 1])
                actions.append(action)
                pieces.append(piece)
                inserted.append(added)
                state = to
        out = pdf[["conv_id", "turn", "role"]].copy()
        return out.assign(new_role=new, action=actions, inserted=inserted, rendered=pieces)

    return (
        known.join(bounds, ["conv", "block"], "left").groupBy("block").applyInPandas(solved, solved_type)
    )
