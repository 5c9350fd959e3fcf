"""Chat formatting: minimum-cost role repair over an automaton of legal turns.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last.
Each given turn is kept, relabelled (``RELABEL``), merged into the turn before (``MERGE``), and
empty turns may be put in before it or at the end (``INSERT`` each); the cheapest sequence wins, ties by the
order of roles. The cost of a stretch of turns is a matrix from the state before to the state after, and stretches
combine by min-plus products. So conversations needn't fit a task: turns are sorted by (conversation, turn) in range partitions;
every partition sends the matrices of its first and last conversation, the only ones that may go on in
another; the driver, with two small rows a partition, fixes the states at the borders; then each
partition repairs and renders its own turns.

Roles are matched without case and outer white space; `human` and `prompter` are user, `bot`, `gpt` and `model`
assistant, `developer` system; any other or a null role fits user and assistant alike at ``RELABEL``. A null
text is an empty turn. Turns with equal numbers go by role and text. A null conversation id is a conversation. Repeated rows are
turns like others (mostly merged), and may lie in several partitions. Texts of any length are only joined. An empty
table gives an empty result. Other columns of the input are not read, so none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, total_text_bytes

RELABEL, MERGE, INSERT = 4.0, 1.0, 3.0
#: Text of a range partition, where ``spark.sql.shuffle.partitions`` gives fewer.
PART_BYTES = 64 << 20
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
#: States: 0 before the first turn, then the last turn's role. LEGAL[s]: what a next turn may be.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
BEGIN, END_TURN = "<|{role}|>\n", "\n<|end|>\n"
INF = float("inf")


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest run of empty turns between a state and one that a turn may follow as ``to``."""
    out = {}
    for s in range(4):
        todo: list[tuple[int, tuple[int, ...]]] = [(s, ())]
        for at, way in todo:
            for to in LEGAL[at]:
                if (s, to) not in out:
                    out[s, to] = way
                if len(way) < 2:
                    todo.append((to, (*way, to)))
    return out


GAPS = _paths()
#: Empty turns that end a conversation from each state.
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def steps(role: int) -> list[list[tuple[float, str]]]:
    """[state before][state after - 1]: cost and action of a turn with a given role (0: unknown)."""
    out = []
    for s in range(4):
        row = []
        for to in (1, 2, 3):
            cost = 0.0 if role == to else RELABEL if role or to > 1 else 2 * RELABEL
            ways = [(cost + MERGE, "merge")] if s == to else []
            if (s, to) in GAPS:
                ways.append((cost + INSERT * len(GAPS[s, to]), "turn"))
            row.append(min(ways, default=(INF, "")))
        out.append(row)
    return out


STEPS = [steps(r) for r in range(4)]
STEP_COST = [np.array([[INF, *(c for c, _ in row)] for row in s]) for s in STEPS]
CLOSE_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus."""
    return (a[:, :, None] + b[None]).min(1)


def total(roles: list[int]) -> np.ndarray:
    m = np.where(np.eye(4), 0.0, INF)
    for r in roles:
        m = product(m, STEP_COST[r])
    return m


def repair(roles: list[int], begin: int = 0, end: np.ndarray | None = None) -> tuple[list[tuple[int, str]], int]:
    """Role and action of each turn on the cheapest way, and the last state; ``end``: the costs after it by state."""
    end = CLOSE_COST if end is None else end
    cost = np.full(4, INF)
    cost[begin] = 0.0
    back = []
    for r in roles:
        c = cost[:, None] + STEP_COST[r]
        back.append(c.argmin(0))
        cost = c.min(0)
    state = int((cost + end).argmin())
    last, way = state, []
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        before = int(b[state])
        way.append((state, STEPS[r][before][state - 1][1], before))
        state = before
    return [(s, a, p) for s, a, p in reversed(way)], last


def render(turn: int, action: str, before: int, text: str, first: bool) -> str:
    """What a turn adds to the rendered conversation; a turn that others are merged into is closed by what follows."""
    out = []
    if action == "merge":
        return "\n" + text
    if not first:
        out.append(END_TURN)
    for gap in GAPS[before, turn]:
        out += [BEGIN.format(role=ROLES[gap - 1]), END_TURN]
    return "".join([*out, BEGIN.format(role=ROLES[turn - 1]), text])


def close(state: int) -> str:
    return END_TURN + "".join(BEGIN.format(role=ROLES[g - 1]) + END_TURN for g in CLOSING[state]) if state else ""


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table, bool, bool]]:
    """The turns of each conversation of a partition in order, in pieces (conversation, turns, first piece, last piece)."""
    held: list[pa.RecordBatch] = []
    conv, begun = None, False
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for a, e in pairwise(cuts):
            if held and ids[a] != conv:
                yield conv, pa.Table.from_batches(held), True, True
                held = []
            conv = ids[a]
            held.append(b.slice(a, e - a))
    if held:
        yield conv, pa.Table.from_batches(held), not begun, True


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each given turn: (conversation, turn, role, new_role, action keep, relabel or merge, n_inserted, rendered).

    ``rendered`` of a conversation's rows in order of (turn, place), joined, is the whole repaired conversation;
    ``place`` numbers its rows in a range partition, ``part`` the partitions.
    """
    spark = turns.sparkSession
    shared_dir(spark)
    kinds = dict(turns.dtypes)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_text_bytes(turns, text_col) // PART_BYTES))
    order = ["conv", "turn", "role", "text"]
    # the last key splits rows that are equal in all; checkpoint() keeps the partitions and their order, which the two passes rely on
    rows = rows.withColumn("any", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *order, "any").sortWithinPartitions(*order).drop("any").checkpoint()

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, last = TaskContext.get().partitionId(), [], None
        for k, (conv, table, _, _) in enumerate(_conversations(batches)):
            m = total([role_of(r) for r in table.column(2).to_pylist()])
            row = (part, k, repr(conv), m.ravel().tolist())
            if k == 0:
                out.append(row)
            last = row
        if last and last[1]:
            out.append(last)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.list_(pa.float64())))], names=["part", "k", "conv", "cost"])

    ends = sorted(map(tuple, rows.mapInArrow(borders, "part int, k long, conv string, cost array<double>").collect()))  # two a partition
    entry, exit_cost, closes = fix_borders(ends)
    plan = spark.sparkContext.broadcast((entry, exit_cost, closes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        entry, exit_cost, closes = plan.value
        for k, (_, table, _, _) in enumerate(_conversations(batches)):
            given, texts = table.column(2).to_pylist(), table.column(3).to_pylist()
            begin, end = entry.get((part, k), 0), exit_cost.get((part, k), CLOSE_COST)
            way, last = repair([role_of(r) for r in given], begin, end)
            out = [render(s, a, p, t or "", p == 0) for (s, a, p), t in zip(way, texts, strict=True)]
            inserted = [len(GAPS[p, s]) if a == "turn" else 0 for s, a, p in way]
            if closes.get((part, k), True):
                out[-1] += close(last)
                inserted[-1] += len(CLOSING[last])
            action = ["merge" if a == "merge" else "keep" if role_of(g) == s else "relabel" for (s, a, _), g in zip(way, given, strict=True)]
            m = len(way)
            cols = [table.column(0).combine_chunks(), table.column(1).combine_chunks(), pa.array(np.full(m, part, np.int32)), pa.array(range(m), pa.int64()), table.column(2).combine_chunks(), pa.array([ROLES[s - 1] for s, _, _ in way]), pa.array(action), pa.array(inserted, pa.int32()), pa.array(out)]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in cols], names=names)

    names = [conv_col, turn_col, "part", "place", "role", "new_role", "action", "n_inserted", "rendered"]
    types = [kinds[conv_col], kinds[turn_col], "int", "bigint", "string", "string", "string", "int", "string"]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))


def fix_borders(ends: list[tuple[int, int, str, list[float]]]) -> tuple[dict, dict, dict]:
    """For conversations over several partitions: each piece's state before it, the costs after it, and whether it is the last."""
    chains: list[list[tuple[int, int, str, list[float]]]] = []
    for row in ends:
        # a conversation goes on from the last one of the partition before to the first one of this
        if chains and row[1] == 0 and chains[-1][-1][2] == row[2] and chains[-1][-1][0] < row[0]:
            chains[-1].append(row)
        else:
            chains.append([row])
    entry, exit_cost, closes = {}, {}, {}
    for chain in chains:
        costs = [np.array(r[3]).reshape(4, 4) for r in chain]
        after = [CLOSE_COST]
        for m in reversed(costs[1:]):
            after.append((m + after[-1][None]).min(1))
        after.reverse()
        state = 0
        for r, m, a in zip(chain, costs, after, strict=True):
            entry[r[:2]], exit_cost[r[:2]], closes[r[:2]] = state, a, r is chain[-1]
            state = int((m[state] + a).argmin())
    return entry, exit_cost, closes
