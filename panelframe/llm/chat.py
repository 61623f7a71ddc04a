"""Minimum-cost role repair of conversations, and rendering.

Legal sequences are: an optional system turn, then user and assistant in turn, ending with the assistant. Each turn may keep its
role, be relabelled, be merged into the turn before it, or have empty turns inserted before it; dynamic
programming over the automaton finds the cheapest repair. Its step is a matrix product in (min, +), which is
associative: conversations are cut into blocks of turns, blocks are summed up as small matrices, a
pass over the matrices fixes the states at the borders, and blocks are repaired on their own. A
huge conversation is many blocks.

The result has a row for each original or inserted turn: conv_id, turn, seq, action (keep, relabel, merge, relabel_merge, insert),
role, rendered. `rendered`, concatenated in the order of (turn, seq), is the conversation in chat format.
Null or unknown role: any role, at a small cost. Null text: empty. Null turn: after all others. Null conv_id is
one conversation. Of repairs that cost the same the one is taken whose sequence of roles is least (system, user, assistant), whatever the
blocks; rows with the same turn are ordered by role and text, and repeated rows are turns like any other. A `<|` in a text is rendered as
`< |`, so no text can close its turn. Very long texts are written whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Last role written: 0 none yet, then 1 + index in ROLES.
STATES = 4
MERGE, RELABEL, UNKNOWN, INSERT = 1.0, 2.0, 0.5, 3.0
FOLLOWS = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
BLOCK = 256
LAST = np.iinfo(np.int64).max


def _ways() -> dict[tuple[int, int], tuple[float, tuple[int, ...], bool]]:
    """How a turn of role q is put after state s: cost, inserted roles, whether it merges."""
    out = {}
    for s in range(STATES):
        for q in range(1, STATES):
            if s == q:
                out[s, q] = (MERGE, (), True)
            elif (s, q) in FOLLOWS:
                out[s, q] = (0.0, (), False)
            else:
                between = [m for m in range(1, STATES) if (s, m) in FOLLOWS and (m, q) in FOLLOWS]
                if between:
                    out[s, q] = (INSERT, (between[0],), False)
    return out


WAYS = _ways()


def _role(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) + 1 if role in ROLES else 0


def _steps(role: int) -> list[tuple[int, int, float]]:
    """(state before, state after, cost) of a turn with this role."""
    label = lambda q: UNKNOWN if role == 0 else 0.0 if q == role else RELABEL
    return [(s, q, cost + label(q)) for (s, q), (cost, _, _) in WAYS.items()]


STEPS = [_steps(r) for r in range(STATES)]
#: Costs in halves, so that they are whole numbers; FAR is more than any sequence costs.
FAR = np.int64(1) << 56
STEP_MATRICES = []
for _own in STEPS:
    _m = np.full((STATES, STATES), FAR)
    for _s, _q, _cost in _own:
        _m[_s, _q] = min(_m[_s, _q], int(2 * _cost))
    STEP_MATRICES.append(_m)
#: From the last state to a legal end: a user turn gets an empty answer, a system turn an empty exchange.
END = np.array([0, int(4 * INSERT), int(2 * INSERT), 0], np.int64)
END_INSERTS = ((), (2, 3), (3,), ())


def block_matrix(roles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least cost from each state before the turns to each after them, and the rank of the way taken: of ways from one state, the one
    with the lesser sequence of states has the lesser rank. Ways to different ends differ, so ranks do not tie."""
    costs = np.where(np.eye(STATES, dtype=bool), np.int64(0), FAR)
    ranks = np.tile(np.arange(STATES), (STATES, 1))
    for r in roles:
        ways = (costs[:, :, None] + STEP_MATRICES[r][None]) * STATES + ranks[:, :, None]
        best = ways.min(axis=1)
        costs = np.minimum(best // STATES, FAR)
        order = (best % STATES) * STATES + np.arange(STATES)  # the sequence so far, then the state it ends in
        ranks = order.argsort(axis=1).argsort(axis=1)
    return costs, ranks


def to_go(matrices: list[np.ndarray], end: np.ndarray) -> list[np.ndarray]:
    """Least cost from each state before each matrix, and after the last, to the end."""
    out = [end]
    for m in reversed(matrices):
        out.append(np.minimum((m + out[-1][None, :]).min(axis=1), FAR))
    return out[::-1]


def least_path(roles: list[int], entry: int, leave: int) -> list[int]:
    """States before each turn and after the last: the least sequence among the cheapest."""
    matrices = [STEP_MATRICES[r] for r in roles]
    rest = to_go(matrices, np.where(np.arange(STATES) == leave, np.int64(0), FAR))
    path = [entry]
    for m, left in zip(matrices, rest[1:], strict=True):
        path.append(int((m[path[-1]] + left).argmin()))  # argmin takes the first, so the least state
    return path


def borders(blocks: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """States before each block and after the last, on the least sequence among the cheapest."""
    rest = to_go([c for c, _ in blocks], END)
    path = [0]
    for (costs, ranks), left in zip(blocks, rest[1:], strict=True):
        s = path[-1]
        path.append(int(((costs[s] + left) * STATES + ranks[s]).argmin()))
    return path


def repair(turns: list[tuple], entry: int, leave: int, last: bool) -> list[tuple]:
    """Rows of a block of (turn, role, text) that is entered and left in these states."""
    roles = [_role(r) for _, r, _ in turns]
    path = least_path(roles, entry, leave)
    out, seq, before = [], 0, None

    def opened(s: int, q: int, text: str) -> str:
        return ("<|end|>\n" if s else "") + f"<|{ROLES[q - 1]}|>\n" + text

    for i, ((turn, _, text), role, s, q) in enumerate(zip(turns, roles, path[:-1], path[1:], strict=True)):
        seq = seq + 1 if i and turn == before else 0
        before = turn
        text = (text or "").replace("<|", "< |")
        _, inserts, merged = WAYS[s, q]
        for m in inserts:
            out.append((turn, seq, "insert", ROLES[m - 1], opened(s, m, "")))
            s, seq = m, seq + 1
        action = ("" if role == q else "relabel") + ("_" if role != q and merged else "") + ("merge" if merged else "")
        out.append((turn, seq, action or "keep", ROLES[q - 1], "\n" + text if merged else opened(s, q, text)))
    if last:
        s = path[-1]
        for m in END_INSERTS[s]:
            seq += 1
            out.append((before, seq, "insert", ROLES[m - 1], opened(s, m, "")))
            s = m
        out[-1] = (*out[-1][:4], out[-1][4] + "<|end|>\n")
    return out


def _turns(table: pa.Table) -> list[tuple]:
    rows = zip(*(table.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True)
    return sorted(rows, key=lambda x: (LAST if x[0] is None else x[0], x[1] or "", x[2] or ""))


def repaired(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text."""
    c = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text", f"coalesce(floor(turn / {BLOCK}), {LAST // BLOCK + 1}) block")

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        found = np.concatenate(block_matrix([_role(r) for _, r, _ in _turns(table)])).ravel().tolist()
        return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()), "costs": pa.array([found], pa.list_(pa.int64()))})

    def bordered(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("block").to_pylist(), table.column("costs").to_pylist(), strict=True))
        path = borders([tuple(np.array(m, np.int64).reshape(2, STATES, STATES)) for _, m in rows])
        n = len(rows)
        return pa.table({"conv_id": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([b for b, _ in rows], pa.int64()), "entry": pa.array(path[:-1], pa.int32()), "leave": pa.array(path[1:], pa.int32()), "is_last": pa.array([i == n - 1 for i in range(n)])})

    def written(key: tuple, table: pa.Table, border: pa.Table) -> pa.Table:
        own = border.to_pylist()[0]
        rows = repair(_turns(table), own["entry"], own["leave"], own["is_last"])
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int64()), *columns], names=["conv_id", "turn", "seq", "action", "role", "rendered"])

    matrices = c.select("conv_id", "block", "turn", "role", F.lit(None).cast("string").alias("text")).groupBy("conv_id", "block").applyInArrow(summed, "conv_id long, block long, costs array<bigint>")
    states = matrices.groupBy("conv_id").applyInArrow(bordered, "conv_id long, block long, entry int, leave int, is_last boolean")
    return c.groupBy("conv_id", "block").cogroup(states.groupBy("conv_id", "block")).applyInArrow(written, "conv_id long, turn long, seq int, action string, role string, rendered string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
