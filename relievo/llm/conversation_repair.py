"""Repair of the turns of conversations by the cheapest edits to a legal order of roles.

A conversation's role initials must be ``(s?(ua)+)?``.  Edits of a turn are Keep (cost 0),
Rerole to user or assistant (1) and Delete (2, the only one for blank and repeated turns);
an empty user or assistant turn may be inserted anywhere (5); an undeleted truncated turn adds
5.  A backward pass gives the least cost to go for every turn and state of the grammar; a
forward walk from the start then takes the ASCII-least letter (D, I, K, R) among the edits
that lie on a cheapest way.  In each state the grammar takes one of u and a only, so a
letter says which role is meant.

Turns are sorted by conversation and turn over all tasks, so a conversation may lie in many
tasks.  A task's stretch of one conversation is a 4 x 4 matrix of least costs from state to
state.  At most the first and the last stretch of a task belong to a conversation of several
tasks; their matrices are multiplied from the back (minimum and sum), which gives each stretch
its costs to go; with these each stretch maps the state it is entered in to the one it is left
in, and these maps are composed from the front.  What passes through the driver is two short
rows a task, whatever the data.  First copies of a turn are found by a grouped minimum and a
join on row numbers, so a line that is repeated a billion times is no hot key.

Defined cases: nulls in role and text count as one space, a null conv_id is a conversation of
its own, null turns come first; turns of equal number go by role, then by the digest of their
text; rows that repeat are turns that repeat; an empty role, or one that does not begin with s,
u or a, cannot be kept; an empty table gives an empty result; extra columns are ignored; texts
of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.llm.common import cut

#: States: nothing yet, after s, after u, after a.  The role that a state takes next, and where it leads.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
NEVER = 1 << 60
ACCEPTED = (0, NEVER, NEVER, 0)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLACK = r"[^\x20\x09-\x0D]"
BLANK_, DUPLICATE_, TRUNCATED_ = 1, 2, 4

Costs = tuple[int, int, int, int]


def with_inserts(base: Costs) -> Costs:
    """Costs to go where turns may be inserted first; more than two never pay."""
    return tuple(min(base[s], INSERT + base[NEXT[s]], 2 * INSERT + base[NEXT[NEXT[s]]]) for s in range(4))


def kept_state(state: int, initial: str) -> int:
    """Where keeping a turn leads; -1 if its role is not allowed here."""
    if initial == "s":
        return 1 if state == 0 else -1
    return NEXT[state] if initial and initial == NEXT_ROLE[state][0] else -1


def before(after: Costs, fault: int, initial: str) -> Costs:
    """Costs to go from in front of a turn, given those from behind it."""
    extra = TRUNCATED if fault == TRUNCATED_ else 0
    base = []
    for s in range(4):
        least = DELETE + after[s]
        if fault not in (BLANK_, DUPLICATE_):
            least = min(least, REROLE + extra + after[NEXT[s]])
            to = kept_state(s, initial)
            if to >= 0:
                least = min(least, KEEP + extra + after[to])
        base.append(min(least, NEVER))
    return with_inserts(tuple(base))


def walk(turns: list[tuple[int, str]], state: int, end: Costs, last: bool) -> tuple[list[tuple[int, str, int, int]], int]:
    """The edits of turns (fault, initial) from ``state`` on, as (turn's place or -1, letter, state before, cost), and the state that is left.

    ``end`` are the costs to go behind the last turn; ``last`` if the conversation ends there, so that turns may be inserted at its end.
    """
    costs = [end]
    for fault, initial in reversed(turns):
        costs.append(before(costs[-1], fault, initial))
    costs.reverse()
    edits: list[tuple[int, str, int, int]] = []
    for k, (fault, initial) in enumerate(turns):
        extra = TRUNCATED if fault == TRUNCATED_ else 0
        while True:
            now, after = costs[k][state], costs[k + 1]
            if now == DELETE + after[state]:
                edits.append((k, "D", state, DELETE))
                break
            if now == INSERT + costs[k][NEXT[state]]:
                edits.append((-1, "I", state, INSERT))
                state = NEXT[state]
                continue
            to = kept_state(state, initial)
            if to >= 0 and now == KEEP + extra + after[to]:
                edits.append((k, "K", state, KEEP + extra))
                state = to
            else:
                edits.append((k, "R", state, REROLE + extra))
                state = NEXT[state]
            break
    while last and ACCEPTED[state]:
        edits.append((-1, "I", state, INSERT))
        state = NEXT[state]
    return edits, state


AT_END = with_inserts(ACCEPTED)


def matrix(turns: list[tuple[int, str]]) -> list[Costs]:
    """Least costs from a state before the turns to a state behind them, by the state behind."""
    columns = []
    for to in range(4):
        costs = tuple(0 if s == to else NEVER for s in range(4))
        for fault, initial in reversed(turns):
            costs = before(costs, fault, initial)
        columns.append(costs)
    return columns


class _Task:
    """The sorted rows of a task as lists, and the stretches of one conversation each."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        table = pa.Table.from_batches(held) if (held := list(batches)) else pa.table({"conv_id": []})
        self.kinds = {f.name: f.type for f in table.schema}
        self.columns = {c: table[c].to_pylist() for c in table.column_names}
        ids = self.columns["conv_id"]
        starts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
        self.stretches = list(zip(starts, [*starts[1:], len(ids)], strict=True))

    def edges(self) -> list[tuple[str, tuple[int, int]]]:
        """The first and, if it is another, the last stretch."""
        s = self.stretches
        return [("first", s[0]), ("last", s[-1])][: len(s)]

    def turns(self, a: int, b: int) -> list[tuple[int, str]]:
        return list(zip(self.columns["fault"][a:b], self.columns["initial"][a:b], strict=True))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last stretch of a task: its matrix and the last initial."""
    from pyspark import TaskContext

    task, part = _Task(batches), TaskContext.get().partitionId()
    last = len(task.stretches) - 1
    rows = [(part, side, side == "last" or last == 0, task.columns["conv_id"][a], [c for col in matrix(task.turns(a, b)) for c in col], task.columns["initial"][b - 1]) for side, (a, b) in task.edges()]
    if rows:
        yield _batch(rows, {"part": pa.int64(), "side": pa.string(), "last": pa.bool_(), "conv_id": task.kinds["conv_id"], "costs": pa.list_(pa.int64()), "initial": pa.string()})


def _mapped(ends: dict):
    """Of stretches of conversations of several tasks: the state each state leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        if (part, "first") in ends or (part, "last") in ends:
            task = _Task(batches)
            rows = [(part, side, [walk(task.turns(a, b), s, *ends[part, side])[1] for s in range(4)]) for side, (a, b) in task.edges() if (part, side) in ends]
            yield _batch(rows, {"part": pa.int64(), "side": pa.string(), "to": pa.list_(pa.int64())})

    return run


def _edited(ends: dict, starts: dict, initials: dict):
    """All stretches: a row per edit, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, rows, order = _Task(batches), TaskContext.get().partitionId(), [], 0
        ids, rid, turn, roles = (task.columns.get(c) for c in ("conv_id", "rid", "turn", "role"))
        kinds = {"conv_id": task.kinds["conv_id"], "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "cost": pa.int64(), "rid": pa.int64(), "turn": task.kinds.get("turn"), "fault": pa.int32(), "illegal": pa.bool_()}
        for k, (a, b) in enumerate(task.stretches):
            side = "first" if k == 0 else "last" if k == len(task.stretches) - 1 else ""
            turns, previous = task.turns(a, b), initials.get(part) if k == 0 else None
            for at, letter, state, cost in walk(turns, starts.get((part, side), 0), *ends.get((part, side), (AT_END, True)))[0]:
                place, order = part << 33 | order, order + 1
                role = NEXT_ROLE[state] if letter in "IR" else roles[a + at] if letter == "K" else None
                if at < 0:
                    rows.append((ids[a], place, letter, role, cost, None, None, 0, False))
                    continue
                fault, initial = turns[at]
                illegal = previous is not None and previous + initial not in ("su", "ua", "au")
                rows.append((ids[a], place, letter, role, cost, rid[a + at], turn[a + at], fault, illegal))
                previous = initial
            if len(rows) >= 1 << 14:
                yield _batch(rows, kinds)
                rows = []
        if rows:
            yield _batch(rows, kinds)

    return run


def _joined_stretches(edges: list) -> tuple[dict, list[list]]:
    """Costs to go behind each edge stretch of a conversation of several tasks, and these conversations' stretches in order."""
    runs: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, e.side)):  # "first" is before "last"
        if runs and e.side == "first" and runs[-1][-1].last and runs[-1][-1].conv_id == e.conv_id:
            runs[-1].append(e)
        else:
            runs.append([e])
    runs, ends = [r for r in runs if len(r) > 1], {}
    for run in runs:
        end, last = AT_END, True
        for e in reversed(run):
            ends[e.part, e.side] = (end, last)
            end, last = tuple(min(min(e.costs[4 * to + s] + end[to] for to in range(4)), NEVER) for s in range(4)), False
    return ends, [[(e.part, e.side, e.initial) for e in run] for run in runs]


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place (order inside the conversation), edit, role, text, cost, turn, fault, illegal, given: one row per edit.

    ``turns``: conv_id, turn, role, text.  ``role`` and ``text`` are what the repaired turn has,
    null for deleted ones; inserted turns have no ``turn`` and ``given`` is false for them.
    ``fault`` is 1 blank, 2 duplicate, 4 truncated, 0 none.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = cut(turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("rid", F.monotonically_increasing_id()))
    black = F.regexp_extract("text", f"({BLACK})[\\x20\\x09-\\x0D]*\\z", 1)
    # The digest of the text alone, so that equal marks mean equal texts.
    narrow = rows.select("rid", "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("mark"), F.substring("role", 1, 1).alias("initial"), (black == "").alias("blank"), black.isin(".", "!", "?").alias("ended"))
    # Turns with equal role and text are in order by turn; the first of them is no duplicate.
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"), F.col("rid"))
    firsts = narrow.groupBy("conv_id", "role", "mark").agg(F.min(order).alias("f")).select(F.col("f.rid").alias("f_rid"))
    fault = F.when(F.col("blank"), BLANK_).when(F.col("f_rid").isNull(), DUPLICATE_).when(~F.col("ended"), TRUNCATED_).otherwise(0)
    flagged = narrow.join(firsts, F.col("rid") == F.col("f_rid"), "left").withColumn("fault", fault.cast("int"))
    keys = ["conv_id", F.col("turn").isNotNull(), "turn", "role", "mark", "rid"]
    sorted_ = cut(flagged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "initial", "fault", "rid"))
    conv, turn = (sorted_.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    # Two rows a task at most, whatever the data.
    edges = sorted_.mapInArrow(_edge_rows, f"part long, side string, last boolean, conv_id {conv}, costs array<long>, initial string").collect()
    ends, runs = _joined_stretches(edges)
    maps = {(r.part, r.side): r.to for r in sorted_.mapInArrow(_mapped(ends), "part long, side string, to array<long>").collect()} if ends else {}
    starts, initials = {}, {}
    for run in runs:
        state = 0
        for k, (part, side, _) in enumerate(run):
            starts[part, side], state = state, maps[part, side][state]
            if k:
                initials[part] = run[k - 1][2]
    edits = sorted_.mapInArrow(_edited(ends, starts, initials), f"conv_id {conv}, place long, edit string, role string, cost long, rid long, turn {turn}, fault int, illegal boolean")
    met = edits.join(rows.select(F.col("rid").alias("t_rid"), "text"), F.col("rid") == F.col("t_rid"), "left")
    text = F.when(F.col("edit") == "I", F.lit("")).when(F.col("edit") != "D", F.col("text"))
    return met.select("conv_id", "place", "edit", "role", text.alias("text"), "cost", "turn", "fault", "illegal", F.col("rid").isNotNull().alias("given"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by the CRC-32 of ``conv_id:turn``, nulls counting as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def audits(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: what was wrong with ``turns`` and what mended it, as digests."""
    count = lambda fault: F.count_if(F.col("fault") == fault).alias
    found = repaired(turns)
    lines = found.select("conv_id", "turn", "cost", "fault", "illegal", "given", F.struct("place", "edit", F.concat_ws(":", F.when(F.col("edit") != "D", F.col("role")), "text").alias("line")).alias("e"))
    # A conversation without turns has only its own row.
    own = conversations.select("conv_id").distinct().select("conv_id", F.lit(None).cast(found.schema["turn"].dataType).alias("turn"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("fault"), F.lit(False).alias("illegal"), F.lit(False).alias("given"), F.lit(None).cast(lines.schema["e"].dataType).alias("e"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    edits = F.array_sort(F.filter(F.collect_list("e"), lambda x: x.isNotNull()))
    each = lines.unionByName(own).groupBy("conv_id").agg(gaps.alias("gaps"), count(BLANK_)("blank"), count(DUPLICATE_)("duplicate"), count(TRUNCATED_)("truncated"), F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"), edits.alias("edits"))
    kept = F.filter("edits", lambda x: x["edit"] != "D")
    return each.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.array_join(F.transform("edits", lambda x: x["edit"]), "").alias("audit"), F.sha2(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"),
    )
