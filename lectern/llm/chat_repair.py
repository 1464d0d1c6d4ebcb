"""Chats made legal at least cost, and rendered.

A chat is legal if it is: maybe one system turn, then user and assistant in turn, ending with the
assistant. Repair may merge a turn into the one before, give it another role, or insert empty
turns. States of the automaton are what stands last: nothing, system, user or assistant. The
effect of a turn is a table of least costs from state to state; the effect of several turns is
the (min, +) product of theirs. Products are associative, so a chat of any length is cut into
stretches, the stretches are folded level by level, the states at all cuts are chosen from the
top down, and each stretch then finds its own cheapest path between two known states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ready, written

ROLES = ("system", "user", "assistant")
#: Names of the roles in other conventions; any other name can become any role at the cost of UNKNOWN.
ALIASES = {
    "human": "user", "prompter": "user", "customer": "user", "developer": "system",
    "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "chatbot": "assistant",
}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 4, 2, 3
#: Turns in a stretch, and stretches folded at a time.
STRETCH = 512
FAR = 1 << 40
#: State after a role: 0 nothing, 1 system, 2 user, 3 assistant.
NEXT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def canonical(role: str | None) -> int:
    """Number of a role; 3 for an unknown, empty or null one. Case and outer spaces don't count."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


@cache
def moves(role: int) -> dict[tuple[int, int], tuple[int, str, int, tuple[int, ...]]]:
    """(state, state) -> (cost, action, label, inserted) for a turn of this role.

    Ties go to the action that stands first of keep, merge, relabel, then to fewer insertions.
    """
    best: dict = {}
    fills = {(s, s): () for s in range(4)}
    for _ in range(2):  # at most two empty turns lead from any state to any other they can reach
        for (a, b), path in list(fills.items()):
            for label in range(3):
                c = NEXT.get((b, label))
                if c is not None and (a, c) not in fills:
                    fills[a, c] = (*path, label)
    for label in range(3):
        change = 0 if label == role else UNKNOWN if role == 3 else RELABEL
        for (a, b), path in fills.items():
            ends = []
            if (b, label) in NEXT:
                ends.append((NEXT[b, label], change + INSERT * len(path), "keep" if not change else "relabel", path))
            if b == label + 1 and not path:
                ends.append((b, change + MERGE, "merge", path))
            for end, cost, action, inserted in ends:
                rank = ("keep", "merge", "relabel").index(action)
                option = (cost, rank, len(inserted), label, action, inserted)
                if (a, end) not in best or option < best[a, end]:
                    best[a, end] = option
    return {k: (o[0], o[4], o[3], o[5]) for k, o in best.items()}


@cache
def costs(role: int) -> np.ndarray:
    table = np.full((4, 4), FAR, np.int64)
    for (a, b), (cost, *_) in moves(role).items():
        table[a, b] = cost
    return table


def product(tables) -> np.ndarray:
    """The (min, +) product, in order."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for t in tables:
        out = np.minimum((out[:, :, None] + t[None]).min(1), FAR)
    return out


#: Cost and empty turns to end a chat after each state.
ENDING = {3: (0, ()), 2: (INSERT, (2,)), 1: (2 * INSERT, (1, 2)), 0: (2 * INSERT, (1, 2))}


def path(tables: list[np.ndarray], start: int, end: int) -> list[int]:
    """States after each table on the cheapest way from ``start`` to ``end``, ties to lower states."""
    ahead = [np.full(4, FAR, np.int64)]
    ahead[0][end] = 0
    for t in reversed(tables):
        ahead.append((t + ahead[-1]).min(1))
    states = []
    for t, after in zip(tables, reversed(ahead[:-1])):
        start = int(np.argmin(t[start] + after))
        states.append(start)
    return states


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their number in the chat from 0, in order of (turn, role, text), nulls first.

    A chat may be longer than a task should sort: it is cut into ranges of ``turn`` first, and a
    small table of range sizes gives each range its offset.
    """
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_r", F.floor(F.coalesce("turn", F.lit(0)) / 65_536))
    rows = rows.withColumn("_r", F.when(F.col("turn").isNull(), F.lit(-(1 << 62))).otherwise(F.col("_r")))
    sizes = rows.groupBy("conv_id", "_r").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("conv_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).withColumn(
        "_n", F.sum("_c").over(Window.partitionBy("conv_id"))
    )
    inside = Window.partitionBy("conv_id", "_r").orderBy("turn", "role", "text")
    ranked = rows.withColumn("_i", F.row_number().over(inside))
    joined = ranked.join(
        offsets.select(F.col("conv_id").alias("_k"), F.col("_r").alias("_q"), "_o", "_n"),
        F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_q")),
    )
    return joined.select(
        "conv_id", "turn", "role", "text", (F.col("_i") + F.col("_o") - 1).cast("bigint").alias("n"),
        F.col("_n").cast("bigint").alias("size"),
    )


def repair(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for every turn of ``turns`` (conv_id, turn, role, text), repaired at least cost.

    conv_id, n (place in the chat, from 0), turn, role, action (keep, merge or relabel), new_role,
    inserted (roles of the empty turns put in before), appended (those put in at the end of the
    chat, on its last turn), cost (of the whole chat) and piece: the pieces of a chat in order of n
    are its rendering. A chat is never gathered, whatever its length.

    Turns with equal (conv_id, turn) are ordered by role and text, exact repeats stay turns of
    their own. Null conv_id is a chat; a null turn comes first; null role is unknown; null text
    is empty. Ties in cost go to keep before merge before relabel, fewer insertions and lower
    states. An empty table gives no rows.
    """
    ready(turns.sparkSession)
    numbered = written(_numbered(turns).withColumn("s", F.floor(F.col("n") / stretch)), "chat-turns")
    conv = numbered.schema["conv_id"].dataType.simpleString()
    kind = f"conv_id {conv}, s bigint, costs array<bigint>"

    def folded(rows: DataFrame, tables) -> DataFrame:
        """One table of costs for each row, whose ``parts`` (bounded by ``stretch``) ``tables`` reads."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [product(tables(parts)).ravel().tolist() for parts in batch.column("parts").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("s"), pa.array(made, pa.list_(pa.int64()))],
                    ["conv_id", "s", "costs"],
                )

        return written(rows.mapInArrow(run, kind), "chat-fold")

    def gathered(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy("conv_id", "s").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("parts"))

    def with_ends(rows: DataFrame, ends: DataFrame) -> DataFrame:
        ends = ends.select(F.col("conv_id").alias("_k"), F.col("s").alias("_s"), "first", "last", "cost")
        same = F.col("conv_id").eqNullSafe(F.col("_k")) & (F.col("s") == F.col("_s"))
        return rows.join(ends, same).drop("_k", "_s")

    levels = [folded(gathered(numbered, "n", "role"), lambda parts: (costs(canonical(x["role"])) for x in parts))]
    while (levels[-1].agg(F.max("s").alias("m")).first()["m"] or 0) > 0:
        upper = levels[-1].withColumnRenamed("s", "below").withColumn("s", F.floor(F.col("below") / stretch))
        made = gathered(upper, "below", "costs")
        levels.append(folded(made, lambda parts: (np.array(x["costs"]).reshape(4, 4) for x in parts)))

    # the top level has one row a chat: it starts with nothing, and ends where that is cheapest
    options = [F.struct((F.col("costs")[i] + ENDING[i][0]).alias("cost"), F.lit(i).alias("last")) for i in range(1, 4)]
    best = F.array_min(F.array(*options))
    ends = levels.pop().select("conv_id", "s", F.lit(0).alias("first"), best["last"].alias("last"), best["cost"].alias("cost"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tables = [np.array(x["costs"]).reshape(4, 4) for x in row["parts"]]
                states = path(tables, row["first"], row["last"])
                for part, first, last in zip(row["parts"], [row["first"], *states], states):
                    out.append((row["conv_id"], part["below"], first, last, row["cost"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                ["conv_id", "s", "first", "last", "cost"],
            )

    for level in reversed(levels):
        lower = level.withColumnRenamed("s", "below").withColumn("s", F.floor(F.col("below") / stretch))
        found = with_ends(gathered(lower, "below", "costs"), ends)
        ends = written(found.mapInArrow(down, f"conv_id {conv}, s bigint, first int, last int, cost bigint"), "chat-ends")

    turn = numbered.schema["turn"].dataType.simpleString()
    fields = (
        f"conv_id {conv}, n bigint, turn {turn}, role string, action string, new_role string,"
        " inserted array<string>, appended array<string>, cost bigint, piece string"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in batch.to_pylist() for r in rendered(row)]
            part = batch.schema.field("parts").type.value_type
            names = pa.list_(pa.string())
            kinds = {
                "conv_id": batch.schema.field("conv_id").type, "n": pa.int64(), "turn": part.field("turn").type,
                "role": pa.string(), "action": pa.string(), "new_role": pa.string(), "inserted": names,
                "appended": names, "cost": pa.int64(), "piece": pa.string(),
            }
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

    return with_ends(gathered(numbered, "n", "turn", "role", "text", "size"), ends).mapInArrow(finish, fields)


def rendered(row: dict) -> Iterator[dict]:
    """The repaired turns of one stretch: its parts, the states at its ends and the cost of the chat."""
    numbers = [canonical(x["role"]) for x in row["parts"]]
    state = row["first"]
    for part, number, after in zip(row["parts"], numbers, path([costs(x) for x in numbers], state, row["last"])):
        _, action, label, inserted = moves(number)[state, after]
        last = part["n"] + 1 == part["size"]
        appended = ENDING[after][1] if last else ()
        # a turn is closed when the next one opens, because a merged turn goes on in it
        opened = [ROLES[x] for x in inserted] + ([ROLES[label]] if action != "merge" else [])
        piece = "".join((CLOSE if i or state else "") + OPEN.format(r) for i, r in enumerate(opened)) or "\n"
        piece += (part["text"] or "") + "".join(CLOSE + OPEN.format(ROLES[x]) for x in appended) + (CLOSE if last else "")
        yield {
            "conv_id": row["conv_id"], "n": part["n"], "turn": part["turn"], "role": part["role"], "action": action,
            "new_role": ROLES[label], "inserted": [ROLES[x] for x in inserted],
            "appended": [ROLES[x] for x in appended], "cost": row["cost"], "piece": piece,
        }
        state = after
