"""Repair of conversations by cheapest edits, found by iterative-deepening A*.

A conversation is a row of codes: the initial of each row's role and its fault.  The search goes depth first through
edits in ASCII order (delete, insert, keep, rerole) under a bound on the cost, which rises until a path is accepted;
what has failed with some amount left is remembered for each state and never tried again with as much or less.  The
first accepting path under the least bound is the answer: the cheapest, and the first of these in ASCII order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .order import in_groups

SEGMENT = 256  # rows searched at once

# What has come so far of (s?(ua)+)?, and what may come next: initial of a role -> state.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
STATE_AFTER = {"s": SYSTEM, "u": ASKED, "a": ANSWERED}
ACCEPTING = (0.0, math.inf, math.inf, 0.0)  # what is still to pay in each state after the last row
CHANGED = ("u", "u", "a", "u")  # the one role that rerole and insert can give in each state
DELETE, CHANGE, INSERT, CUT = 3, 2, 2, 1
FULL = {"u": "user", "a": "assistant"}


class Search:
    """Edits of one run of rows: codes are an initial and a fault (b: must go, t: truncated, -: none) for each row.

    ``rest``: what is still to pay after the run, by state.  Only the ``last`` run of a conversation may insert after
    its last row: between two runs, inserts belong to the later one, so that no path of a run is the beginning of
    another.
    """

    def __init__(self, codes: Sequence[str], rest: Sequence[float] = ACCEPTING, last: bool = True):
        self.rows = [(c[:1], c[1:]) for c in codes]
        self.rest, self.last = rest, last
        self.failed: dict[tuple[int, int], float] = {}
        n = len(self.rows)
        # From each row on: what rows cost at least, the next row that can stay, and how often neighbours do not fit.
        self.least, self.kept, self.misfits = [0] * (n + 1), [n] * (n + 1), [0] * (n + 1)
        if not last:
            self.least[n] = min(rest)
        for i in reversed(range(n)):
            initial, fault = self.rows[i]
            self.least[i] = self.least[i + 1] + (DELETE if fault == "b" else CUT if fault == "t" else 0)
            self.kept[i], self.misfits[i] = (self.kept[i + 1], self.misfits[i + 1]) if fault == "b" else (i, self._after(i))

    def _after(self, i: int) -> int:
        """Misfits from row i, which stays, to the end."""
        state = STATE_AFTER.get(self.rows[i][0])
        at = self.kept[i + 1]
        return self.misfits[i + 1] + self._misfit(state, at)

    def _misfit(self, state: int | None, at: int) -> int:
        if at == len(self.rows):
            return int(self.last and (state is None or self.rest[state] > 0))
        return int(state is None or self.rows[at][0] not in NEXT[state])

    def bound(self, at: int, state: int) -> float:
        """No more than what the rows from ``at`` cost: an edit of 2 or 3 mends two misfits at most."""
        return self.least[at] + self.misfits[at] + self._misfit(state, self.kept[at])

    def edits(self, at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, next row, next state) in ASCII order."""
        out, changed = [], STATE_AFTER[CHANGED[state]]
        if at < len(self.rows):
            initial, fault = self.rows[at]
            cut = CUT if fault == "t" else 0
            out = [("D", DELETE, at + 1, state), ("I", INSERT, at, changed)]
            if fault != "b":
                if initial in NEXT[state]:
                    out.append(("K", cut, at + 1, NEXT[state][initial]))
                out.append(("R", CHANGE + cut, at + 1, changed))
        elif self.last:
            out = [("I", INSERT, at, changed)]
        return out

    def best(self, state: int) -> tuple[float, str, int] | None:
        """(cost with the rest, letters, state after the run) of the first cheapest path; None where there is none."""
        limit = self.bound(0, state)
        while limit < math.inf:
            found, limit = self._deepen(state, limit)
            if found:
                return limit, *found
        return None

    def _deepen(self, state: int, limit: float) -> tuple[tuple[str, int] | None, float]:
        """((letters, last state), limit) of the first path within the limit, or None and the next limit to try."""
        n, beyond, letters = len(self.rows), math.inf, []
        stack = [(0, state, limit, None)]  # row, state, what is left to spend, edits not tried yet
        while stack:
            at, state, left, todo = stack.pop()
            if todo is None:
                over = max(self.bound(at, state), self.rest[state] if at == n and not self.last else 0) - left
                failed = self.failed.get((at, state), -1)
                if at == n and self.rest[state] <= left:
                    return ("".join(letters), state), limit
                if over > 0 or failed >= left:
                    beyond = min(beyond, limit + max(over, failed + 1 - left))
                    letters[-1:] = []
                    continue
                todo = iter(self.edits(at, state))
            edit = next(todo, None)
            if edit is None:
                self.failed[at, state] = max(left, self.failed.get((at, state), -1))
                letters[-1:] = []
                continue
            stack.append((at, state, left, todo))
            letter, cost, row, after = edit
            letters.append(letter)
            stack.append((row, after, left - cost, None))
        return None, beyond


def new_roles(codes: Sequence[str], letters: str, state: int) -> str:
    """For each letter the initial of the role that it gives, ``-`` where it gives none."""
    out, at = [], 0
    for letter in letters:
        initial = CHANGED[state] if letter in "IR" else "-"
        if letter != "D":
            state = STATE_AFTER[codes[at][:1] if letter == "K" else initial]
        at += letter != "I"
        out.append(initial)
    return "".join(out)


def run_costs(codes: Sequence[str], last: bool) -> np.ndarray:
    """Least cost from each state before a run to each state after it (4 x 4): plain sums, no paths."""
    costs = np.full((4, 4), np.inf)
    np.fill_diagonal(costs, 0)

    def with_insert(m: np.ndarray) -> np.ndarray:
        # One insert for each state that follows: another two would come back to the same state.
        for _ in range(3):
            moved = m.copy()
            for state in range(4):
                after = STATE_AFTER[CHANGED[state]]
                moved[:, after] = np.minimum(moved[:, after], m[:, state] + INSERT)
            m = moved
        return m

    for code in codes:
        initial, fault = code[:1], code[1:]
        before = with_insert(costs)
        costs = before + DELETE
        if fault != "b":
            cut = CUT if fault == "t" else 0
            for state in range(4):
                after = STATE_AFTER[CHANGED[state]]
                costs[:, after] = np.minimum(costs[:, after], before[:, state] + CHANGE + cut)
                if initial in NEXT[state]:
                    kept = NEXT[state][initial]
                    costs[:, kept] = np.minimum(costs[:, kept], before[:, state] + cut)
    return with_insert(costs) if last else costs


def with_faults(rows: DataFrame, conversation: str, order: Sequence[Column], role: str = "role", text: str = "text") -> DataFrame:
    """The rows with ``conv`` (number of the conversation), ``place`` in it, ``initial`` of the role, and ``fault``.

    Faults: blank (nothing but white space), duplicate (role and text came earlier in the conversation), truncated
    (does not end in ``.``, ``!`` or ``?``), null.  The first that holds counts.  Null roles and texts must have been
    replaced; an empty role has the initial ``?``.  Rows are spread by conversation and order; the earliest rows of
    equal role and text come from counts by digest, which combine before they are shuffled.  The columns that are
    added must not be there yet.
    """
    if clash := {"conv", "place", "initial", "fault"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows have columns {sorted(clash)} already")
    placed, (number, place) = in_groups(rows, conversation, order)
    placed = placed.withColumnsRenamed({number: "conv", place: "place"})
    shown = F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+\z", "")
    placed = placed.withColumns(
        {
            "_same": F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256),
            "_blank": shown == "",
            "_cut": ~F.substring(shown, -1, 1).isin(".", "!", "?"),
            "initial": F.when(F.col(role) == "", "?").otherwise(F.substring(role, 1, 1)),
        }
    )
    placed = materialize(placed, "placed")
    repeated = placed.groupBy(F.col("conv").alias("_conv"), F.col("_same").alias("_digest")).agg(
        F.min("place").alias("_earliest"), F.count("*").alias("_n")
    )
    same = (F.col("conv") == F.col("_conv")) & (F.col("_same") == F.col("_digest"))
    placed = placed.join(repeated.filter("_n > 1"), same, "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("place") > F.col("_earliest"), "duplicate")
    placed = placed.withColumn("fault", fault.when(F.col("_cut"), "truncated"))
    return placed.drop("_same", "_blank", "_cut", "_conv", "_digest", "_earliest", "_n")


def runs_of(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv, segment, final (the conversation's last segment), codes: runs of at most ``segment`` rows."""
    letter = F.when(F.col("fault") == "truncated", "t").when(F.col("fault").isNull(), "-").otherwise("b")
    cell = F.expr(f"place div {segment}")
    code = F.struct("place", F.concat("initial", letter).alias("code"))
    runs = rows.groupBy("conv", cell.alias("segment")).agg(F.sort_array(F.collect_list(code)).alias("rows"))
    ends = rows.groupBy("conv").agg(F.max(cell).alias("final"))
    return materialize(runs.join(ends, "conv").select("conv", "segment", "final", F.col("rows.code").alias("codes")), "runs")


def find_edits(runs: DataFrame) -> DataFrame:
    """conv, segment, letters, roles, cost of each run: the first cheapest edits of whole conversations.

    A conversation of any length is searched in parallel and never held whole.  For the runs after the first, least
    costs from each state to each other are summed up backwards, one run at a time; so each run knows what is still
    to pay in each state after it, and finds its first cheapest path from each state that it may begin with.  One
    walk forwards then follows the states.  Nearly all conversations are one run, which begins in one state.
    ``cost`` is that of the run and all after it.
    """
    rest_type = pa.list_(pa.float64())

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("codes", "segment", "final"))
            values = [run_costs(c, s == f).ravel().tolist() for c, s, f in zip(*columns)]
            kept = [batch.column(c) for c in ("conv", "segment", "final")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, rest_type)], names=["conv", "segment", "final", "costs"])

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.array(ACCEPTING)
        for batch in batches:
            values = []
            for here, final, m in zip(*(batch.column(c).to_pylist() for c in ("segment", "final", "costs"))):
                rest = (np.array(m).reshape(4, 4) + (np.array(ACCEPTING) if here == final else rest)).min(axis=1)
                values.append(rest.tolist())
            # What is to pay from here on is what is still to pay after the run before.
            earlier = pc.subtract(batch.column("segment"), 1)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), earlier, pa.array(values, rest_type)], names=["conv", "segment", "rest"])

    later = runs.filter("segment > 0").mapInArrow(costs, "conv bigint, segment bigint, final bigint, costs array<double>")
    later = later.repartition("conv").sortWithinPartitions("conv", F.col("segment").desc())
    rests = later.mapInArrow(backwards, "conv bigint, segment bigint, rest array<double>")

    kinds = {"conv": pa.int64(), "segment": pa.int64(), "before": pa.int32(), "after": pa.int32()}
    kinds |= {"letters": pa.string(), "roles": pa.string(), "cost": pa.float64()}
    schema = "conv bigint, segment bigint, before int, after int, letters string, roles string, cost double"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv", "segment", "final", "codes", "rest"))
            for conv, here, final, codes, rest in zip(*columns):
                run = Search(codes, ACCEPTING if here == final else rest, here == final)
                for before in range(4) if here else (START,):
                    if found := run.best(before):
                        cost, letters, after = found
                        out.append((conv, here, before, after, letters, new_roles(codes, letters, before), cost))
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds.values())], names=list(kinds))

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, segment = None, START, -1
        for batch in batches:
            followed = []
            columns = (batch.column(c).to_pylist() for c in ("conv", "segment", "before", "after"))
            for i, (c, s, before, after) in enumerate(zip(*columns)):
                if c != conv:
                    conv, state, segment = c, START, -1
                if s > segment and before == state:  # one path of each run
                    followed.append(i)
                    state, segment = after, s
            yield batch.take(pa.array(followed, pa.int64()))

    paths = runs.join(rests, ["conv", "segment"], "left").select("conv", "segment", "final", "codes", "rest")
    paths = paths.mapInArrow(search, schema).repartition("conv").sortWithinPartitions("conv", "segment")
    found = paths.mapInArrow(forwards, schema).select("conv", "segment", "letters", "roles", "cost")
    return materialize(found, "edits")


def apply_edits(rows: DataFrame, edits: DataFrame, segment: int = SEGMENT, role: str = "role", text: str = "text") -> DataFrame:
    """conv, place, step, edit, role, text of the repaired conversations, in order of conv, segment, step.

    ``place`` is that of the row which the edit takes, or before which it inserts.
    """
    names = ["conv", "segment", "place", "step", "edit", "given"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("conv", "segment", "letters", "roles"))
            for conv, here, letters, roles in zip(*columns):
                place = here * segment
                for step, (letter, initial) in enumerate(zip(letters, roles)):
                    if letter != "D":
                        out.append((conv, here, place, step, letter, FULL.get(initial)))
                    place += letter != "I"
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

    steps = edits.mapInArrow(one_by_one, "conv bigint, segment bigint, place bigint, step int, edit string, given string")
    old = rows.select("conv", "place", F.col(role).alias("old_role"), F.col(text).alias("old_text"))
    steps = steps.join(old, ["conv", "place"], "left")
    return steps.select(
        "conv", "segment", "place", "step", "edit",
        F.coalesce("given", "old_role").alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("old_text")).alias("text"),
    )


def line_hashes(repaired: DataFrame) -> DataFrame:
    """conv, sha256: of the lines ``role:text`` of each conversation, read one by one in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None

        def of(found: list[tuple[int, str]]) -> pa.RecordBatch:
            convs, hashes = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(hashes, pa.string())], names=["conv", "sha256"])

        for batch in batches:
            done = []
            for c, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist()):
                if c == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256()
                digest.update(line.encode())
            yield of(done)
        if digest is not None:
            yield of([(conv, digest.hexdigest())])

    lines = repaired.select("conv", "segment", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv").sortWithinPartitions("conv", "segment", "step").mapInArrow(run, "conv bigint, sha256 string")


def illegal_pairs(runs: DataFrame) -> DataFrame:
    """conv, illegal: neighbours whose initials are not su, ua or au, within runs and from one run to the next."""
    initial = lambda code: F.substring(code, 1, 1)
    heads = runs.filter("segment > 0").select(
        F.col("conv").alias("_conv"), (F.col("segment") - 1).alias("_segment"), F.col("codes")[0].alias("_head")
    )
    joined = runs.join(heads, (F.col("conv") == F.col("_conv")) & (F.col("segment") == F.col("_segment")), "left")
    codes = F.when(F.col("_head").isNull(), F.col("codes")).otherwise(F.concat("codes", F.array("_head")))
    pairs = F.zip_with(
        F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.concat(initial(a), initial(b))
    )
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    return joined.groupBy("conv").agg(F.sum(illegal).alias("illegal"))


def repair(rows: DataFrame, conversation: str, order: Sequence[Column], segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their faults, edits of each run, the repaired rows); see the functions above.

    ``rows`` have role and text, without nulls; ``order`` gives the order within a conversation, rows that are equal
    in it in any order.  A null conversation is one like the others.  Roles that begin with none of s, u, a cannot
    be kept.  Very long texts are only compared by digest.  An empty table gives empty results; a conversation
    without rows is in none of them.
    """
    found = materialize(with_faults(rows, conversation, order), "faults")
    edits = find_edits(runs_of(found, segment))
    return found, edits, apply_edits(found, edits, segment)


def audits(edits: DataFrame) -> DataFrame:
    """conv, cost, audit: all letters of a conversation."""
    letters = F.sort_array(F.collect_list(F.struct("segment", "letters")))
    cost = F.min_by("cost", "segment").cast("bigint")
    return edits.groupBy("conv").agg(cost.alias("cost"), F.array_join(letters["letters"], "").alias("audit"))
