"""Conversation repair as shortest paths, found by an auction.

A conversation's rows, by turn (nulls first; equal turns by role, then text), run through a
lattice: a node is a place between rows and the state of the roles written so far. Arcs
keep a row, change its role, delete it, or insert an empty turn, at integer costs. The
auction keeps a price per node and one path: the path grows along the arc that attains
its end's price, or the price rises to its cheapest arc and the path gives up its end. On
arrival the origin's price is the least cost, and every arc of every cheapest path is
tight; of the tight paths that arrive, the one with the least letters is taken.

The rows are sorted and numbered by range, so no conversation meets in one task. Runs of up
to ``RUN`` rows are solved by themselves. A conversation of several runs gets the costs
from state to state of each run, combined run by run up a tree of up to ``FAN`` children,
and the exact prices at each run's end back down; its runs are then traced with these.
Only the checksum needs a conversation's rows in sequence: they stream, sorted, through
one task, which holds one letter per row.

Null roles and texts count as one space. Rows with a null id are one conversation. Repeated
rows are duplicates. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tabulon.llm.common import kept, numbered, slices, small_or_plain
from tabulon.session import task_count

#: Rows of a run; rows that one group of runs is cut from, as a power of two; children of a
#: node of the tree, as a power of two.
RUN, CHUNK_BITS, FAN_BITS = 64, 12, 6
CHUNKS_PER_TASK = 16
DELETE, RENAME, INSERT, TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"

# States of the roles written: none, after s, after u, after ua.
STATES = 4
NEXT = (2, 2, 3, 2)  # where an inserted or renamed row leads
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {2: "user", 3: "assistant"}
CLOSING = ("", "II", "I", "")  # inserts that complete the roles
LEGAL = frozenset(("su", "ua", "au"))
NEVER = float("inf")

Arc = tuple[str, int, int]  # letter, cost, node it leads to


def closing_costs() -> list[float]:
    return [INSERT * len(letters) for letters in CLOSING]


def row_arcs(cells: str) -> list[list[Arc]]:
    """Arcs of each node, letters in ASCII order; node 4 i + q is state q before row i.

    A cell is d (must go) or a role's initial s, u, a or x (any other), in upper case if
    the row is truncated.
    """
    arcs: list[list[Arc]] = []
    for i, cell in enumerate(cells):
        extra = TRUNCATED if cell.isupper() else 0
        role = cell.lower()
        for state in range(STATES):
            here, after = 4 * i, 4 * i + 4
            out = [("D", DELETE, after + state), ("I", INSERT, here + NEXT[state])]
            if role != "d":
                if (state, role) in KEPT:
                    out.append(("K", extra, after + KEPT[state, role]))
                out.append(("R", RENAME + extra, after + NEXT[state]))
            arcs.append(out)
    return arcs


def cost_arcs(tables: list[list[float]]) -> list[list[Arc]]:
    """Arcs over whole runs, from their 4 x 4 costs; a negative cost is no arc."""
    return [
        [("", table[4 * state + to], 4 * i + 4 + to) for to in range(STATES) if table[4 * state + to] >= 0]
        for i, table in enumerate(tables) for state in range(STATES)
    ]


class Lattice:
    """Arcs with prices for given costs behind the last layer."""

    def __init__(self, arcs: list[list[Arc]], ends: list[float], most: float):
        self.least = min(ends)
        self.sink = len(arcs) + STATES
        closing = [[("", cost - self.least, self.sink)] if cost < NEVER else [] for cost in ends]
        self.arcs = arcs + closing
        self.price: list[float] = [0] * (self.sink + 1)
        # no finite path costs as much
        self.limit = most + max(cost - self.least for cost in ends if cost < NEVER) + 4 * INSERT

    def settle(self, origin: int) -> float:
        """The least cost from the origin on; never, if there is no path."""
        price, arcs, path = self.price, self.arcs, [origin]
        while path[-1] != self.sink:
            node, best, to = path[-1], NEVER, -1
            for _, cost, target in arcs[node]:
                if cost + price[target] < best:
                    best, to = cost + price[target], target
            if best > self.limit:
                best = NEVER
            if price[node] < best:  # contraction
                price[node] = best
                if node != origin:
                    path.pop()
            elif best == NEVER:
                return NEVER
            else:  # extension
                path.append(to)
        return price[origin] + self.least

    def trace(self, origin: int) -> tuple[str, int]:
        """Letters of the least tight path from a settled origin, and its last state."""
        price, arcs = self.price, self.arcs
        path, letters, tried, dead = [origin], [], [0], set()
        while path[-1] != self.sink:
            node, at = path[-1], tried[-1]
            if at == len(arcs[node]):  # tight arcs that lead nowhere
                dead.add(node)
                path.pop(), tried.pop(), letters.pop()
                continue
            tried[-1] = at + 1
            letter, cost, target = arcs[node][at]
            if price[node] == cost + price[target] and target not in dead:
                path.append(target), letters.append(letter), tried.append(0)
        return "".join(letters), path[-2] - (self.sink - STATES)


def run_costs(arcs: list[list[Arc]], most: float) -> list[float]:
    """Least costs from each state before to each state behind, row by row; -1: no path."""
    table = [-1] * STATES**2
    for to in range(STATES):
        lattice = Lattice(arcs, [0 if state == to else NEVER for state in range(STATES)], most)
        for state in range(STATES):
            cost = lattice.settle(state)
            table[4 * state + to] = -1 if cost == NEVER else cost
    return table


def most_of(table: list[float]) -> float:
    return max(table)


def child_ends(tables: list[list[float]], ends: list[float]) -> list[list[float]]:
    """Least costs behind each child, from the costs behind the last."""
    lattice = Lattice(cost_arcs(tables), ends, sum(map(most_of, tables)))
    out = [ends]
    for i in range(len(tables) - 1, 0, -1):
        out.append([lattice.settle(4 * i + state) for state in range(STATES)])
    return out[::-1]


def traced(cells: str, ends: list[float], states: range) -> tuple[list[str], list[int], list[int]]:
    """Letters, last state and own cost from each entry state."""
    lattice = Lattice(row_arcs(cells), ends, DELETE * len(cells))
    letters, last, costs = [], [], []
    for state in states:
        total = lattice.settle(state)
        if total == NEVER:
            letters.append(""), last.append(0), costs.append(0)
            continue
        path, to = lattice.trace(state)
        letters.append(path), last.append(to), costs.append(int(total - ends[to]))
    return letters, last, costs


# -- tables -------------------------------------------------------------------------------

RUN_SCHEMA = """who string, pos long, cells string, first string, last string, illegal long, blank long, duplicate long,
    truncated long, low long, high long, turns long, whole boolean, costs array<long>"""


def conversation_key(column: Column) -> Column:
    """Text that stands for an id, null among them."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def texts(df: DataFrame, present: str | None = None) -> DataFrame:
    """who, conv, turn, role, text without nulls, and whether the row is there."""
    space = F.lit(" ")
    return df.select(
        conversation_key(F.col("conv_id")).alias("who"), F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )


def in_order() -> list[Column]:
    return [F.col("who"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def cells(rows: DataFrame) -> DataFrame:
    """who, turn, pos (dense, in order), cell and initial of every row that is there.

    The first row of equal ones is found by two counts per text, never by gathering them.
    """
    bare = F.rtrim("text", F.lit(SPACES))
    content = F.concat_ws(":", F.octet_length("who"), "who", F.octet_length("role"), "role", "text")
    light = rows.where("present").orderBy(*in_order()).select(
        "who", "turn", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.unhex(F.sha2(content, 256)).alias("key"))
    light = numbered(light, "pos")
    again = kept(light.groupBy("key").agg(F.min("pos").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    marked = light.join(small_or_plain(again, 64), "key", "left").withColumn(
        "same", F.coalesce(F.col("pos") != F.col("earliest"), F.lit(False)))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    cell = F.when(F.col("blank"), "b").when(F.col("same"), "d").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    return marked.select("who", "turn", "pos", cell.alias("cell"), initial.alias("initial"))


def runs_of(table: pa.Table, rows: int = RUN) -> Iterator[dict]:
    """Runs of one conversation in a stretch of consecutive rows, with their figures."""
    table = table.sort_by("pos")
    who, turn, pos, cell, initial = (table.column(n).to_pylist() for n in ("who", "turn", "pos", "cell", "initial"))
    at, total = 0, len(who)
    while at < total:
        end = at
        while end < total and who[end] == who[at]:
            end += 1
        whole = at > 0 and end < total and end - at <= rows
        for start in range(at, end, rows):
            stop = min(start + rows, end)
            own = "".join(cell[start:stop])
            known = [t for t in turn[start:stop] if t is not None]
            yield {
                "who": who[at], "pos": pos[start], "cells": own.replace("b", "d"), "first": initial[start], "last": initial[stop - 1],
                "illegal": sum(initial[i] + initial[i + 1] not in LEGAL for i in range(start, stop - 1)),
                "blank": own.count("b"), "duplicate": own.count("d"), "truncated": sum(map(str.isupper, own)),
                "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)), "whole": whole,
                "costs": None if whole else run_costs(row_arcs(own.replace("b", "d")), DELETE * len(own)),
            }
        at = end


def runs(rows: DataFrame, run: int = RUN, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Every run, and its costs from state to state unless it is a whole conversation."""
    def cut(key, table):
        return pa.Table.from_pylist(list(runs_of(table, run)), schema=table_schema)

    table_schema = arrow_schema(RUN_SCHEMA)
    marked = cells(rows).withColumn("chunk", F.shiftright("pos", chunk_bits))
    # rows that are few by bytes but costly to work on: the number of tasks is named
    last = marked.agg(F.max("chunk")).first()[0] or 0
    marked = marked.repartition(task_count(rows.sparkSession, last + 1, CHUNKS_PER_TASK), "chunk")
    return kept(marked.groupBy("chunk").applyInArrow(cut, RUN_SCHEMA))


def arrow_schema(ddl: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl)


def run_ends(cut: DataFrame, chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """who, pos and ``ends``, the least costs behind each run (per state), for runs of cut
    conversations. Groups of runs are joined upwards until one stands for a conversation."""
    node_schema = "who string, pos long, costs array<long>"
    end_schema = "who string, pos long, ends array<long>"
    node_fields, end_fields = arrow_schema(node_schema), arrow_schema(end_schema)

    def join(key, table):
        table = table.sort_by("pos")
        tables = table.column("costs").to_pylist()
        joined = tables[0] if len(tables) == 1 else run_costs(cost_arcs(tables), sum(map(most_of, tables)))
        return pa.Table.from_pylist([{"who": key[0].as_py(), "pos": table.column("pos")[0].as_py(), "costs": joined}], node_fields)

    def hand_down(key, table, above):
        table = table.sort_by("pos")
        ends = [NEVER if cost < 0 else cost for cost in above.column("ends")[0].as_py()]
        found = child_ends(table.column("costs").to_pylist(), ends)
        plain = [[-1 if cost == NEVER else int(cost) for cost in costs] for costs in found]
        return pa.table([table.column("who"), table.column("pos"), plain], schema=end_fields)

    levels, shift = [kept(cut.select("who", "pos", "costs"))], chunk_bits
    shifts: list[int] = []
    while levels[-1].count() > levels[0].select("who").distinct().count():
        parent = F.shiftright("pos", shift).alias("parent")
        levels.append(kept(levels[-1].select("*", parent).groupBy("who", "parent").applyInArrow(join, node_schema)))
        shifts.append(shift)
        shift += fan_bits
    ends = levels.pop().select("who", "pos", F.array(*[F.lit(c).cast("long") for c in closing_costs()]).alias("ends"))
    while levels:
        parent = F.shiftright("pos", shifts.pop()).alias("parent")
        children = levels.pop().select("*", parent).groupBy("who", "parent")
        ends = kept(children.cogroup(ends.select("*", parent).groupBy("who", "parent")).applyInArrow(hand_down, end_schema))
    return ends


TRACE = "letters array<string>, states array<int>, own array<long>"


def traces(found: DataFrame, ends: DataFrame) -> DataFrame:
    """The runs with letters, last state and cost from each state they can be entered in."""
    names = [n for n in found.columns if n != "costs"]
    schema = StructType([*found.select(*names).schema.fields, *StructType.fromDDL(TRACE).fields])
    fields = arrow_schema(schema)

    def run(batches):
        for part in slices(batches):
            out = []
            for own, behind in zip(part.column("cells").to_pylist(), part.column("ends").to_pylist()):
                costs = closing_costs() if behind is None else [NEVER if c < 0 else c for c in behind]
                out.append(traced(own, costs, range(1 if behind is None else STATES)))
            added = [pa.array(list(values), fields.field(n).type) for values, n in zip(zip(*out), ("letters", "states", "own"))]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *added], schema=fields)

    cut = ends.select(F.col("who").alias("__who"), F.col("pos").alias("__pos"), "ends")
    joined = found.join(cut, (F.col("who") == F.col("__who")) & (F.col("pos") == F.col("__pos")), "left")
    return joined.select(*names, "ends").mapInArrow(run, schema)


class Conversation:
    """Figures and repaired turns of one conversation, from its runs and then its rows."""

    def __init__(self, conv):
        self.conv, self.state, self.parts, self.cost = conv, 0, [], 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.low = self.high = self.last = None
        self.audit: str | None = None
        self.at = 0

    def add_run(self, run: dict) -> None:
        for name in self.counts:
            self.counts[name] += run[name]
        if self.last is not None and self.last + run["first"] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = run["last"]
        if run["low"] is not None:
            if self.high == run["low"]:  # a turn on both sides of the cut
                self.counts["turns"] -= 1
            self.low, self.high = (run["low"] if self.low is None else self.low), run["high"]
        self.parts.append(run["letters"][self.state])
        self.cost += run["own"][self.state]
        self.state = run["states"][self.state]

    def _close(self) -> None:
        if self.audit is None:
            self.audit = "".join(self.parts) + CLOSING[self.state]
            self.cost += INSERT * len(CLOSING[self.state])
            self.parts, self.state = [], 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            yield "I", NAMES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Letter, role and text of the turns up to this row."""
        self._close()
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[self.state, role[:1]]
            yield letter, role, text
        elif letter == "R":
            self.state = NEXT[self.state]
            yield letter, NAMES[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        self._close()
        yield from self._inserted()

    def figures(self) -> dict:
        self._close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {"conv_id": self.conv, "gaps": gaps, **{n: self.counts[n] for n in ("blank", "duplicate", "truncated", "illegal")},
                "cost": int(self.cost), "audit": self.audit}


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's runs and then its rows, in order, in one partition."""
    run_fields = [f for f in found.schema.fields if f.name not in ("who", "pos")]
    names = [f.name for f in run_fields]
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    text_fields = [rows.schema[n] for n in ("conv", "turn", "role", "text")]
    left = found.select("who", F.lit(0).alias("kind"), "pos", *names, *map(none, text_fields))
    here = [F.when(F.col("present"), F.col(n)).alias(n) for n in ("turn", "role", "text")]
    kind = F.when(F.col("present"), 1).otherwise(2).alias("kind")
    right = rows.select("who", kind, F.lit(None).cast("long").alias("pos"), *map(none, run_fields), "conv", *here)
    both = left.unionByName(right).repartition("who")
    return both.sortWithinPartitions("who", "kind", "pos", F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches, turn, done):
    """Walk the stream: ``turn`` gets each repaired turn, ``done`` each finished conversation."""
    who, current = None, None
    for part in slices(batches):
        for row in part.to_pylist():
            if row["who"] != who:
                if current is not None:
                    _finish(current, turn, done)
                who, current = row["who"], Conversation(row["conv"])
            if row["kind"] == 0:
                current.add_run(row)
                continue
            current.conv = row["conv"]
            if row["kind"] == 1:
                for made in current.row(row["role"], row["text"]):
                    turn(current, *made)
        yield
    if current is not None:
        _finish(current, turn, done)
    yield


def _finish(current, turn, done):
    for made in current.rest():
        turn(current, *made)
    done(current)


def solved(df: DataFrame, present: str | None = None, run: int = RUN, chunk_bits: int = CHUNK_BITS,
           fan_bits: int = FAN_BITS) -> DataFrame:
    """The stream of solved runs and rows that the results are read from."""
    rows = texts(df, present)
    found = runs(rows, run, chunk_bits)
    ends = run_ends(found.where("not whole"), chunk_bits, fan_bits)
    return _streamed(rows, traces(found, ends))


def audited(df: DataFrame, present: str | None = None, **sizes: int) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256. Rows whose ``present`` column isn't true only name their conversation."""
    stream = solved(df, present, **sizes)
    schema = StructType([StructField("conv_id", df.schema["conv_id"].dataType), *StructType.fromDDL(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    fields = arrow_schema(schema)

    def run(batches):
        ready: list[dict] = []

        def turn(current, letter, role, text):
            if not hasattr(current, "sum"):
                current.sum = hashlib.sha256()
            else:
                current.sum.update(b"\n")
            current.sum.update(f"{role}:{text}".encode())

        def done(current):
            total = getattr(current, "sum", hashlib.sha256())
            ready.append(current.figures() | {"repaired_sha256": total.hexdigest()})

        for _ in _conversations(batches, turn, done):
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=fields)
                ready.clear()

    return stream.mapInArrow(run, schema)


def repaired(df: DataFrame, present: str | None = None, **sizes: int) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text and edit (K, R or I)."""
    stream = solved(df, present, **sizes)
    schema = StructType([StructField("conv_id", df.schema["conv_id"].dataType), *StructType.fromDDL(
        "place long, role string, text string, edit string").fields])
    fields = arrow_schema(schema)

    def run(batches):
        ready: list[dict] = []

        def turn(current, letter, role, text):
            current.place = getattr(current, "place", -1) + 1
            ready.append({"conv_id": current.conv, "place": current.place, "role": role, "text": text, "edit": letter})

        for _ in _conversations(batches, turn, lambda current: None):
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=fields)
                ready.clear()

    return stream.mapInArrow(run, schema)


def damaged(df: DataFrame) -> DataFrame:
    """Every row with the damage that its id and turn draw, and ``present``: dropped rows stay
    as rows that are not present. Repeated rows come twice."""
    texted = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(texted("conv_id"), F.lit(":"), texted("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", texted("role").alias("role"), texted("text").alias("text"), draw.alias("__draw"))
    drawn = lambda n: F.col("__draw") == n
    text = F.when(drawn(1), "").when(drawn(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(drawn(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(drawn(4), "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (~drawn(0)).alias("present"), F.explode(times).alias("__time")).drop("__time")
