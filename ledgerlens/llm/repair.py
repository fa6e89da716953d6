"""Cheapest repair of conversations to the role pattern ``(s?(ua)+)?``.

Edits of a row: keep it, give it the role that is due, delete it; an empty turn of the role that is due may be inserted anywhere.  Of the
cheapest repairs the one with the ASCII-least audit, the string of edit initials, is taken.

A conversation of any length is spread over tasks: rows are sorted by range, and the part of a conversation in one partition is
a slice.  A slice answers with a 4 x 4 matrix, the least cost from each role state before it to each behind it; the few slices
of a conversation are folded from the end to costs at their borders, and again from the start to the state in which the path enters each.
Inside a slice, cost to the end gives the optimal arcs.  Their nodes are ranked by the audits of 1, 2, 4, ... edits from
them on, each round joining a node's rank with that of the node its pointer leads to and doubling the pointer; the path follows the arc with
the least (initial, rank of its target), read off by the doubled pointers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Role states: nothing yet, behind a system turn, behind a user's, behind an assistant's.
STATES = 4
NEXT = (2, 2, 3, 2)  # state behind a rerole or an insertion
DUE = ("user", "user", "assistant", "user")
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
FAR = 1 << 50  # more than any path costs
#: What is left to pay behind the last row: an answer after a user's turn, a pair after a system's.
LAST = (0, 2 * INSERT, INSERT, 0)
FAULTS = ("blank", "duplicate", "truncated")
VISIBLE = r"[^\x20\x09-\x0D]"

STEP = "struct<place: long, kind: string, copies: long>"


# ---------------------------------------------------------------- one slice

def _closed(h: list) -> list:
    """Costs from a place on, insertions there included, given the costs ``h`` without."""
    pair = INSERT + min(h[2], INSERT + h[3])
    return [min(h[0], pair), min(h[1], pair), min(h[2], INSERT + h[3]), min(h[3], INSERT + h[2])]


def _taken(kind: str, copies: int, g: list) -> list:
    """Costs before a row (kind: initial, fault) without insertions there, given those behind it."""
    initial, fault = kind[:-1], kind[-1]
    rest = DELETE * (copies - 1)
    if fault in "bd":
        return [DELETE + rest + v for v in g]
    extra = TRUNCATED if fault == "t" else 0
    h = [min(REROLE + extra + g[NEXT[x]], DELETE + g[x]) + rest for x in range(STATES)]
    for x in range(STATES):
        y = KEPT.get((x, initial))
        if y is not None:
            h[x] = min(h[x], extra + g[y] + rest)
    return h


def border_costs(steps: list[tuple[str, int]], behind: list) -> list[list]:
    """Costs to the end before each row and behind the last, insertions included; ``behind``: those behind the slice."""
    g = [list(behind)]
    for kind, copies in reversed(steps):
        g.append(_closed(_taken(kind, copies, g[-1])))
    return g[::-1]


def slice_matrix(steps: list[tuple[str, int]]) -> list[list]:
    """Least cost from each state before the slice to each state behind it, without insertions behind its last row."""
    columns = []
    for y in range(STATES):
        columns.append(border_costs(steps, [0 if x == y else FAR for x in range(STATES)])[0])
    return [[columns[y][x] for y in range(STATES)] for x in range(STATES)]


def least_paths(steps: list[tuple[str, int]], behind: list) -> tuple[list[str], list[int]]:
    """(audit, state behind the slice) of the least optimal path from each state before the slice.

    An edit leads from a node (place, state) to one node, so a node's least audit begins with its least optimal initial.
    A row of several equal copies adds a deletion for every further one.
    """
    n = len(steps)
    g = border_costs(steps, behind)
    size = (n + 1) * STATES + 1  # the last node stands for all that lies behind the slice
    arcs = []  # (initial, target) of each node's optimal arcs
    for i, (kind, copies) in enumerate(steps):
        initial, fault = kind[:-1], kind[-1]
        rest, extra = DELETE * (copies - 1), TRUNCATED if fault == "t" else 0
        for x in range(STATES):
            here, below = g[i][x], (i + 1) * STATES
            out = []
            if here == DELETE + rest + g[i + 1][x]:
                out.append((2, below + x))
            if here == INSERT + g[i][NEXT[x]]:
                out.append((3, i * STATES + NEXT[x]))
            if fault not in "bd":
                y = KEPT.get((x, initial))
                if y is not None and here == extra + rest + g[i + 1][y]:
                    out.append((4, below + y))
                if here == REROLE + extra + rest + g[i + 1][NEXT[x]]:
                    out.append((5, below + NEXT[x]))
            arcs.append(out)
    arcs += [[(1, size - 1)]] * STATES + [[(0, size - 1)]]
    width = max(map(len, arcs))
    initials = np.full((size, width), 9, np.int64)
    targets = np.full((size, width), size - 1, np.int64)
    for v, out in enumerate(arcs):
        for k, (letter, w) in enumerate(out):
            initials[v, k], targets[v, k] = letter, w
    first = initials.argmin(1)
    every = np.arange(size)
    rank, leap = initials[every, first], targets[every, first]
    leaps, reached = [], 1
    while reached <= 3 * n + 2:  # at most two insertions go with a row
        leaps.append(leap)
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[leap], return_inverse=True)[1].astype(np.int64)
        leap = leap[leap]
        reached *= 2
    choice = (initials * (size + 1) + rank[targets]).argmin(1)
    letter, target = initials[every, choice], targets[every, choice]
    audits, exits = [], []
    for x in range(STATES):
        path = np.array([x])
        for k in leaps:  # the path's nodes double with each pointer
            path = np.concatenate([path, k[path]])
        path = path[letter[path] > 1]
        last = int(target[path[-1]]) if len(path) else x
        audits.append("".join(
            "D" * steps[v // STATES][1] if z == 2 else "I" if z == 3 else "KR"[z - 4] + "D" * (steps[v // STATES][1] - 1)
            for v, z in zip(path.tolist(), letter[path].tolist(), strict=True)))
        exits.append(last - n * STATES)
    return audits, exits


def closing(state: int) -> str:
    """The insertions behind the last row."""
    return ("", "II", "I", "")[state]


def applied(audit: str, state: int, steps: list[tuple[int, str, int]]):
    """(edit, place or None, role or None for the row's own) of every letter of an audit that enters in ``state``; the
    deletions of further copies go with the place of their row."""
    out, i, left = [], 0, 0
    for edit in audit:
        if edit == "I":
            out.append(("I", None, DUE[state]))
            state = NEXT[state]
            continue
        if not left:
            place, kind, left = steps[i]
            i += 1
        left -= 1
        if edit == "D":
            out.append(("D", place, None))
        elif edit == "R":
            out.append(("R", place, DUE[state]))
            state = NEXT[state]
        else:
            out.append(("K", place, None))
            state = KEPT[state, kind[:-1]]
    return out, state


# ------------------------------------------------------------------- tables

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with damage by crc32(conv_id:turn) mod 20.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.  Nulls count as one space, in the key
    as in role and text; a null conv_id or turn stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"), fate.alias("_fate")).where("_fate <> 0")
    f = F.col("_fate")
    text = F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(f == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and ``place``: rising by conversation, turn (null first), role and text, its upper
    bits the slice.  Written, so that places are fixed."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    each = rows.select(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"),
                       F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    each = each.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = ["conv", "turn", "role", "text"]
    laid = each.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(laid.withColumn("place", F.monotonically_increasing_id()), "repair-rows")


def _steps(placed: DataFrame) -> DataFrame:
    """Rows without their texts: (conv, slice, place, turn, kind, copies), kind the role's initial and b, d, t or - for its fault."""
    seen = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    narrow = placed.select(
        "conv", "place", "turn", "copies", F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("text").rlike(VISIBLE), "b").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "t").otherwise("-").alias("fault"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("what"))
    first = narrow.groupBy(F.col("conv").alias("f_conv"), F.col("what").alias("f_what")).agg(F.min("place").alias("f_place"))
    told = narrow.join(first, (F.col("conv") == F.col("f_conv")) & (F.col("what") == F.col("f_what")), "left")
    fault = F.when(F.col("fault") == "b", "b").when(F.col("place") > F.col("f_place"), "d").otherwise(F.col("fault"))
    return told.select("conv", F.shiftright("place", 33).alias("slice"), "place", "turn", "copies", F.concat("initial", fault).alias("kind"))


def _slices(steps: DataFrame) -> DataFrame:
    """One row per slice with its steps in order; a slice is bounded by its partition."""
    each = F.col("copies")
    fault = F.substring("kind", -1, 1)
    # of several copies that are neither blank nor repeated, all but the first repeat it
    of = {"b": F.when(fault == "b", each).otherwise(0), "t": F.when(fault == "t", 1).otherwise(0),
          "d": F.when(fault == "d", each).when(fault != "b", each - 1).otherwise(0)}
    return steps.groupBy("conv", "slice").agg(
        F.sort_array(F.collect_list(F.struct("place", "kind", "copies"))).alias("steps"),
        F.sum(of["b"]).alias("blank"), F.sum(of["d"]).alias("duplicate"), F.sum(of["t"]).alias("truncated"))


def _arrow(df: DataFrame, answer, schema: str) -> DataFrame:
    """``df`` row by row through ``answer(row) -> rows``."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            out = [r for row in b.to_pylist() for r in answer(row)]
            for lo in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[lo:lo + 10_000], schema=shape)

    return df.mapInArrow(run, schema)


def _illegal(steps) -> int:
    """Neighbours inside a slice whose initials may not follow each other, copies of one row included."""
    bad, before = 0, None
    for s in steps:
        initial = s["kind"][:-1]
        bad += before is not None and before + initial not in LEGAL
        bad += (s["copies"] - 1) * (initial + initial not in LEGAL)
        before = initial
    return bad


def _summary(row):
    steps = [(s["kind"], s["copies"]) for s in row["steps"]]
    yield {"conv": row["conv"], "slice": row["slice"], "matrix": [c for line in slice_matrix(steps) for c in line],
           "illegal": _illegal(row["steps"]), "first": steps[0][0][:-1], "last": steps[-1][0][:-1]}


def _borders(row):
    """Costs behind each slice of a conversation, from its last slice back, and what neighbouring slices add to ``illegal``."""
    parts = row["parts"]
    behind = list(LAST)
    bad = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    for p in reversed(parts):
        yield {"conv": row["conv"], "slice": p["slice"], "behind": behind, "illegal": bad if p is parts[0] else 0}
        m = p["matrix"]
        behind = _closed([min(m[x * STATES + y] + behind[y] for y in range(STATES)) for x in range(STATES)])


def _paths(row):
    audits, exits = least_paths([(s["kind"], s["copies"]) for s in row["steps"]], row["behind"])
    yield {"conv": row["conv"], "slice": row["slice"], "audits": audits, "exits": exits}


def _chosen(row):
    """The state in which the path enters each slice, and the audit of each."""
    state, parts = 0, row["parts"]
    for p in parts:
        audit = p["audits"][state] + (closing(p["exits"][state]) if p is parts[-1] else "")
        yield {"conv": row["conv"], "slice": p["slice"], "state": state, "audit": audit}
        state = p["exits"][state]


def _edits(row):
    out, _ = applied(row["audit"], row["state"], [(s["place"], s["kind"], s["copies"]) for s in row["steps"]])
    for i, (edit, place, role) in enumerate(out):
        yield {"conv": row["conv"], "slice": row["slice"], "at": i, "edit": edit, "place": place, "due": role}


class Repair:
    """The repair of a table of rows (conv_id, turn, role, text).

    Rows go by turn (null first), role and text; null roles and texts are one space, a null conv_id is a conversation of its own,
    other columns are ignored.  Of a row's faults the first counts: blank text, role and text seen earlier, last visible character
    not ``[.!?]``.  A row repeated in full is its own duplicate.  No rows, no edits.
    """

    def __init__(self, rows: DataFrame):
        self.rows = _placed(rows)
        self.slices = materialise(_slices(_steps(self.rows)), "repair-slices")
        summaries = _arrow(self.slices.select("conv", "slice", "steps"), _summary,
                           "conv string, slice long, matrix array<long>, illegal long, first string, last string")
        parts = summaries.groupBy("conv").agg(F.sort_array(F.collect_list(
            F.struct("slice", "matrix", "illegal", "first", "last"))).alias("parts"))  # at most one part per partition
        self.borders = materialise(_arrow(parts, _borders, "conv string, slice long, behind array<long>, illegal long"), "repair-borders")
        open_ = self.slices.select("conv", "slice", "steps").join(self.borders.select("conv", "slice", "behind"), ["conv", "slice"])
        paths = _arrow(open_, _paths, "conv string, slice long, audits array<string>, exits array<long>")
        ways = paths.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("slice", "audits", "exits"))).alias("parts"))
        self.audits = materialise(_arrow(ways, _chosen, "conv string, slice long, state long, audit string"), "repair-audits")

    def edits(self) -> DataFrame:
        """(conv_id, slice, at, edit, turn, role, text): one row per audit letter, in order of (slice, at); deleted rows and copies too."""
        acts = _arrow(self.audits.join(self.slices.select("conv", "slice", "steps"), ["conv", "slice"]), _edits,
                      "conv string, slice long, at long, edit string, place long, due string")
        text = self.rows.select(F.col("place").alias("r_place"), "turn", F.col("role").alias("r_role"), F.col("text").alias("r_text"))
        own = acts.where("place is not null").join(text, F.col("place") == F.col("r_place"))
        new = acts.where("place is null").select("*", F.lit(None).cast("long").alias("turn"), F.lit("").alias("r_role"), F.lit("").alias("r_text"))
        both = own.drop("r_place").unionByName(new)
        return both.select(_conv_id(), "slice", "at", "edit", "turn", F.coalesce("due", "r_role").alias("role"), F.col("r_text").alias("text"))

    def repaired(self) -> DataFrame:
        """The repaired rows: :meth:`edits` without deletions."""
        return self.edits().where("edit <> 'D'")

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
        turns = self.rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
            F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count("turn").alias("n"))
        faults = self.slices.groupBy("conv").agg(*(F.sum(f).alias(f) for f in FAULTS))
        bad = self.borders.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
        costs = self.audits.groupBy("conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slice", "audit"))),
                                                                         lambda p: p["audit"]), "").alias("audit"))
        start = self.borders.join(self.slices.select("conv", "slice", "steps"), ["conv", "slice"])
        first = start.join(self.audits.where("state = 0").groupBy("conv").agg(F.min("slice").alias("slice")), ["conv", "slice"], "left_semi")
        cost = _arrow(first.select("conv", "steps", "behind"), lambda r: iter([{"conv": r["conv"], "cost": border_costs(
            [(s["kind"], s["copies"]) for s in r["steps"]], r["behind"])[0][0]}]), "conv string, cost long")
        out = turns.join(faults, "conv").join(bad, "conv").join(costs, "conv").join(cost, "conv")
        gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).cast("long")
        return out.select(_conv_id(), gaps.alias("gaps"), *FAULTS, "illegal", "cost", "audit")


def _conv_id() -> Column:
    return F.when(F.col("conv") != "n", F.substring("conv", 2, 20).cast("long")).alias("conv_id")


def joined_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): hash of ``role:text`` of each conversation's repaired rows, joined by line feeds.

    Rows stream through their conversation's hash in order, so no conversation is ever held whole; a hash is taken in one task by nature.
    """
    def digest(batches):
        at, h = None, None
        for b in batches:
            done, ids = [], []
            conv, role, text = (b.column(i).to_pylist() for i in (0, 3, 4))
            for c, r, t in zip(conv, role, text, strict=True):
                if h is not None and c == at:
                    h.update(b"\n")
                else:
                    if h is not None:
                        ids.append(at)
                        done.append(h.hexdigest())
                    at, h = c, hashlib.sha256()
                h.update(f"{r}:{t}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(done, pa.string())], ["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

    laid = repaired.select("conv_id", "slice", "at", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "at")
    return laid.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_digests(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repair of ``rows`` for every conv_id of ``whole``.

    A conversation without rows, or of which nothing is left, has the digest of the empty text; without rows its numbers are 0.
    """
    done = Repair(rows)
    every = whole.select(F.col("conv_id").cast("long").alias("w_id")).distinct()
    facts = done.summary().withColumnRenamed("conv_id", "s_id")
    digests = joined_digests(done.repaired()).withColumnRenamed("conv_id", "d_id")
    out = every.join(facts, F.col("w_id").eqNullSafe(F.col("s_id")) & F.col("audit").isNotNull(), "left").join(
        digests, F.col("w_id").eqNullSafe(F.col("d_id")) & F.col("repaired_sha256").isNotNull(), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    return out.select(F.col("w_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
