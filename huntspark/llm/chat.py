"""Chat formatting by minimum-cost role repair.

A conversation is legal when it is an optional system turn followed by user and
assistant turns that alternate, begin with user and end with assistant. Every
turn is read by an automaton with the states start, system, user and assistant
(the role of the last turn written). For each turn dynamic programming may keep
its role or relabel it, may merge it into the last turn of the same role, and
may insert an empty turn of the role that is missing; the sum of the costs is
the least possible. Among repairs of equal cost the first turn that differs
decides: the move listed first in ``MOVES`` wins.

A turn is a 4 x 4 min-plus matrix, so a long conversation is cut into chunks of
``chunk`` turn numbers: chunk matrices give the cost to go behind every chunk,
with that each chunk says for every state it may be entered in where it is
left, and with the entry states all chunks are repaired in parallel. The result
does not depend on where the cuts are.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut_lineage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow what, and where a conversation may end.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
COST = {"keep": 0, "merge": 1, "relabel": 2, "unknown": 1, "insert": 3}
CHUNK = 4096
INF = np.inf


def moves(role: str | None) -> list[tuple[float, int, int, int, bool]]:
    """All ``(cost, from, to, inserted role or -1, merged)`` for a turn of this role, preferred ones first."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for state in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            price = COST["keep"] if to == own else COST["unknown"] if own is None else COST["relabel"]
            if to in LEGAL[state]:
                out.append((price, state, to, -1, False))
            if to == state:
                out.append((price + COST["merge"], state, to, -1, True))
            for between in LEGAL[state]:
                if to in LEGAL[between]:
                    out.append((price + COST["insert"], state, to, between, False))
    return sorted(out, key=lambda m: (m[1], m[2] != own, m[4], m[3] >= 0, m[0], m[2], m[3]))


#: An unknown role is None.
MOVES = {r: moves(r) for r in (*ROLES, None)}
MATRIX = {}
for _role, _list in MOVES.items():
    MATRIX[_role] = np.full((4, 4), INF)
    for _cost, _from, _to, _, _ in _list:
        MATRIX[_role][_from, _to] = min(MATRIX[_role][_from, _to], _cost)
#: Cost of ending in each state, and what is inserted then.
END = np.array([0, 2 * COST["insert"], COST["insert"], 0], dtype=float)
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def known(role) -> str | None:
    role = role.strip().lower() if isinstance(role, str) else None
    return role if role in ROLES else None


def product(roles) -> np.ndarray:
    """The matrix of a run of turns."""
    total = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        total = (total[:, :, None] + MATRIX[r][None, :, :]).min(axis=1)
    return total


def repair(roles, entry: int, to_go: np.ndarray):
    """The best moves of a run of turns from ``entry`` when leaving it costs ``to_go``; and the state it is left in."""
    left = [to_go]
    for r in reversed(roles):
        left.append((MATRIX[r] + left[-1][None, :]).min(axis=1))
    left.reverse()
    state, chosen = entry, []
    for i, r in enumerate(roles):
        for cost, start, to, between, merged in MOVES[r]:
            if start == state and cost + left[i + 1][to] == left[i][state]:
                chosen.append((to, between, merged))
                state = to
                break
    return chosen, state


def header(role: int) -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n"


CLOSE = "<|im_end|>\n"


def _runs(batches, columns):
    """Consecutive rows of one (conversation, chunk), over batch borders."""
    held, name = [], None
    for pdf in batches:
        for row in zip(*[pdf[c] for c in columns]):
            if (row[0], row[1]) != name:
                if held:
                    yield name, held
                held, name = [], (row[0], row[1])
            held.append(row)
    if held:
        yield name, held


def repaired(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per turn of the repaired conversations.

    Returns ``conv_id string, chunk, seq, turn, role_in, role, action, text,
    rendered``: ``action`` is keep, relabel, merge, relabel+merge or insert;
    the ``rendered`` pieces of a conversation, joined by ``chunk`` and ``seq``,
    are its formatted text. Turns are ordered by number (NULL first, in hash
    order), then role and text; every turn is kept, also an exact repeat. A task
    holds the turns of a chunk of turn numbers, with their repeats. A NULL conversation id is a conversation of its own. NULL texts are empty, a NULL or
    unknown role is free to become any. Other columns are not carried.
    """
    number = F.col(turn).cast("bigint")
    mix = F.xxhash64(F.col(role), F.col(text))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("")).alias("_conv"),
        F.when(number.isNull(), F.shiftrightunsigned(mix, 54) - 2**40).otherwise(F.floor(number / chunk)).cast("bigint").alias("_chunk"),
        F.when(number.isNull(), mix).otherwise(number).alias("_order"), number.alias("_turn"), F.col(role).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Conversations of several chunks: their costs to go and entry states, from roles alone.
    span = rows.groupBy("_conv").agg(F.min("_chunk").alias("a"), F.max("_chunk").alias("b"))
    long = span.filter("a < b").select("_conv")
    roles = rows.join(long, "_conv", "left_semi").select("_conv", "_chunk", "_order", "_role", "_text")
    roles = cut_lineage(roles.withColumn("_text", F.xxhash64("_text")))

    def sorted_runs(df: DataFrame) -> DataFrame:
        return df.repartition("_conv", "_chunk").sortWithinPartitions("_conv", "_chunk", "_order", "_role", "_text")

    def matrices(batches):
        out = [(c, k, product([known(r[2]) for r in run]).ravel().tolist()) for (c, k), run in _runs(batches, ("_conv", "_chunk", "_role"))]
        yield pd.DataFrame(out, columns=["_conv", "_chunk", "_m"])

    costs = cut_lineage(sorted_runs(roles).select("_conv", "_chunk", "_role").mapInPandas(matrices, "_conv string, _chunk bigint, _m array<double>"))

    @F.pandas_udf("array<array<double>>")
    def suffixes(column: pd.Series) -> pd.Series:
        def one(ms):
            to_go, out = END, []
            for m in reversed(list(ms)):
                out.append(to_go.tolist())
                to_go = (np.array(m).reshape(4, 4) + to_go[None, :]).min(axis=1)
            return out[::-1]
        return column.map(one)

    # One row per chunk: as many as the conversation has times `chunk` turn numbers.
    listed = costs.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_chunk", "_m"))).alias("l"))
    behind = listed.select("_conv", F.explode(F.arrays_zip(F.col("l._chunk").alias("_chunk"), suffixes(F.col("l._m")).alias("_to_go"))).alias("x")).select("_conv", "x._chunk", "x._to_go")

    def exits(batches):
        out = []
        for (c, k), run in _runs(batches, ("_conv", "_chunk", "_role", "_to_go")):
            seq, to_go = [known(r[2]) for r in run], np.array(run[0][3], dtype=float)
            out.append((c, k, [repair(seq, s, to_go)[1] for s in range(4)], to_go.tolist()))
        yield pd.DataFrame(out, columns=["_conv", "_chunk", "_exit", "_to_go"])

    walked = sorted_runs(roles.join(behind, ["_conv", "_chunk"])).select("_conv", "_chunk", "_role", "_to_go").mapInPandas(exits, "_conv string, _chunk bigint, _exit array<int>, _to_go array<double>")
    so_far = F.collect_list("_exit").over(Window.partitionBy("_conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    entry = F.aggregate(so_far, F.lit(START), lambda s, e: F.element_at(e, s + 1))
    entries = cut_lineage(walked.withColumn("_entry", entry).withColumn("_last", F.row_number().over(Window.partitionBy("_conv").orderBy(F.desc("_chunk"))) == 1)
                          .select("_conv", "_chunk", "_entry", "_to_go", "_last"))

    def render(batches):
        out = []
        for (c, k), run in _runs(batches, ("_conv", "_chunk", "_turn", "_role", "_text", "_entry", "_to_go", "_last")):
            state, to_go, last = (START, END, True) if run[0][6] is None else (int(run[0][5]), np.array(run[0][6], dtype=float), bool(run[0][7]))
            chosen, end = repair([known(r[3]) for r in run], state, to_go)
            seq = 0
            for row, (to, between, merged) in zip(run, chosen):
                shut = CLOSE if state != START else ""
                if between >= 0:
                    out.append((c[1:] if c else None, k, seq, None, None, ROLES[between - 1], "insert", "", shut + header(between)))
                    seq, shut = seq + 1, CLOSE
                changed = known(row[3]) != ROLES[to - 1]
                action = ("relabel+merge" if changed else "merge") if merged else ("relabel" if changed else "keep")
                out.append((c[1:] if c else None, k, seq, row[2], row[3], ROLES[to - 1], action, row[4], "\n\n" + row[4] if merged else shut + header(to) + row[4]))
                seq, state = seq + 1, to
            if last:
                for extra in ENDING[end]:
                    out.append((c[1:] if c else None, k, seq, None, None, ROLES[extra - 1], "insert", "", CLOSE + header(extra)))
                    seq += 1
                out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
            if len(out) > 10_000:
                yield frame(out)
                out = []
        yield frame(out)

    names = ["conv_id", "chunk", "seq", "turn", "role_in", "role", "action", "text", "rendered"]

    def frame(out):
        return pd.DataFrame(out, columns=names).astype({"chunk": "int64", "seq": "int64"})

    ready = sorted_runs(rows.join(entries, ["_conv", "_chunk"], "left"))
    # The NULL turns of a chunk carry no number into pandas, which would make it a float.
    ready = ready.withColumn("_turn", F.col("_turn").cast("string"))
    done = ready.mapInPandas(render, "conv_id string, chunk bigint, seq bigint, turn string, role_in string, role string, action string, text string, rendered string")
    return done.withColumn("turn", F.col("turn").cast("bigint"))
