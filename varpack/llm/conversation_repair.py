"""Repair of conversation structure: least cost, least audit.

The edits of a conversation are a path through nodes (row, state of the role
grammar ``(s?(ua)+)?``). A cost DP from the end finds the arcs of cheapest paths.
Their nodes are ranked by prefix doubling: by the first edit, then by the first
two, four, eight, ... edits, each rank being the rank of a pair (own rank, rank at
the end of the doubled pointer). The ranks decide between paths that end in
different states, and the doubled pointers mark the nodes of the least path.

A conversation may be of any length. Rows are put in order by a range shuffle on
(conversation, turn, role, text), so a long conversation spreads over partitions;
blocks of at most ``BLOCK`` consecutive rows are solved each on its own. A block
says for the conversations at its two ends what it costs to get from each state
to each state and how the least audits between them rank; a conversation's blocks
are then chained (an audit is one string, so fewer than 2**31 rows and 2**15
blocks), which fixes the state between blocks, and the blocks write their part of
the audit. Equal rows of one turn are one row with a count: all but the first are
duplicates. Hashing the repaired text needs one ordered stream per conversation:
sorted rows pass through a running SHA-256, and no text is held.

Defined cases: a null role or text is one space, a null turn sorts first, null
conversation ids are one conversation; rows of one turn are taken by role, then by
the MD5 of their text; texts are told apart by that MD5 within a conversation and
role; a role's initial is its first character (an empty role has none, and such a
row can only be given another role or deleted); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shuffle import bounded_batches, written

BLOCK = 1 << 16
SPACE = " \t\n\x0b\f\r"

# States: nothing yet, after s, after u, after a. Costs and labels of the edits.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
SPOKEN = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])      # where the next user or assistant row leads
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LABELS = np.array(["", "D", "I", "K", "R"])                  # in ASCII order
END, D, I, K, R = range(5)
NONE = np.int64(1) << 60
FINAL = np.array([0, NONE, NONE, 0], np.int64)               # states in which a conversation may end
ROLES = np.array(["", "user", "assistant"])

FREE, FORCED, CUT_OFF = range(3)                             # rows: any edit, must go, truncated


# ------------------------------------------------------------------ one block

def _keep_to(initial: np.ndarray) -> np.ndarray:
    """(rows, 4): the state after keeping a row, -1 where that is not allowed."""
    to = np.full((len(initial), 4), -1)
    to[initial == "s", START] = AFTER_S
    for state in (START, AFTER_S, AFTER_A):
        to[initial == "u", state] = AFTER_U
    to[initial == "a", AFTER_U] = AFTER_A
    return to


class Paths:
    """Cheapest edits of several runs of rows at once. ``starts`` bounds the runs
    (one more entry than runs), ``ends`` (runs, 4) is the cost from each last
    state on, ``inserts`` (runs) whether rows may be inserted after the last row."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, starts: np.ndarray, ends: np.ndarray, inserts: np.ndarray):
        runs = len(starts) - 1
        size = np.diff(starts)
        # Every run has one place more than rows: nodes are (place, state).
        self.first = starts[:-1] + np.arange(runs)
        self.last = self.first + size
        places = len(initial) + runs
        self.row = np.full(places, -1)
        keep = np.ones(places, bool)
        keep[self.last] = False
        self.row[keep] = np.arange(len(initial))
        to = _keep_to(initial)
        extra = np.where(fault == CUT_OFF, TRUNCATED, 0).astype(np.int64)
        free = fault != FORCED

        cost = np.full((places, 4), NONE)
        last = ends.astype(np.int64).copy()
        for _ in range(3):
            last = np.where(inserts[:, None], np.minimum(last, np.minimum(last[:, SPOKEN] + INSERT, NONE)), last)
        cost[self.last] = last
        order = np.argsort(-size, kind="stable")
        by_size = size[order]
        states = np.arange(4)
        for step in range(1, int(size.max(initial=0)) + 1):       # the cost DP, runs side by side
            at = self.last[order[:np.searchsorted(-by_size, -step, side="right")]] - step
            r = self.row[at]
            then = cost[at + 1]
            best = then + DELETE
            may = free[r]
            kept = np.where((to[r] >= 0) & may[:, None], np.take_along_axis(then, np.maximum(to[r], 0), 1) + KEEP + extra[r, None], NONE)
            named = np.where(may[:, None], then[:, SPOKEN] + RENAME + extra[r, None], NONE)
            best = np.minimum(np.minimum(best, kept), np.minimum(named, NONE))
            for _ in range(3):
                best = np.minimum(best, best[:, SPOKEN] + INSERT)
            cost[at] = best
        self.cost = cost

        # The first edit in ASCII order among the arcs of cheapest paths; an edit's
        # label decides the state it leads to, so it is the node's only arc that counts.
        has = self.row >= 0
        r = np.maximum(self.row, 0)
        nxt = np.minimum(np.arange(places) + 1, places - 1)
        row_like = len(initial) > 0
        extra_at = extra[r] if row_like else np.zeros(places, np.int64)
        free_at = (free[r] if row_like else np.zeros(places, bool)) & has
        to_at = to[r] if row_like else np.full((places, 4), -1)
        may_insert = has.copy()
        may_insert[self.last] = inserts
        label = np.zeros((places, 4), np.int64)
        target = np.tile(states, (places, 1)) + 4 * np.arange(places)[:, None]
        here = 4 * np.arange(places)[:, None]
        onward = 4 * nxt[:, None]
        options = [
            (R, free_at[:, None] & np.ones((1, 4), bool), cost[nxt][:, SPOKEN] + RENAME + extra_at[:, None], onward + SPOKEN),
            (K, free_at[:, None] & (to_at >= 0), np.take_along_axis(cost[nxt], np.maximum(to_at, 0), 1) + KEEP + extra_at[:, None], onward + np.maximum(to_at, 0)),
            (I, may_insert[:, None] & np.ones((1, 4), bool), cost[:, SPOKEN] + INSERT, here + SPOKEN),
            (D, has[:, None] & np.ones((1, 4), bool), cost[nxt] + DELETE, onward + states),
        ]
        for code, allowed, price, goal in options:               # the least label is written last
            use = allowed & (price == cost) & (cost < NONE)
            label[use] = code
            target[use] = goal[use]
        self.label, self.target = label.reshape(-1), target.reshape(-1)

    def rank(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all nodes by their least audits, and the nodes on the paths
        from state ``entry`` of each run (-1: none)."""
        rank, pointer = self.label.copy(), self.target.copy()
        marked = np.zeros(len(rank), bool)
        use = entry >= 0
        marked[4 * self.first[use] + entry[use]] = True
        while True:
            marked[pointer[marked]] = True
            _, rank = np.unique(rank * (len(self.label) + 5) + rank[pointer], return_inverse=True)
            doubled = pointer[pointer]
            if (doubled == pointer).all():
                return rank, marked
            pointer = doubled

    def edits(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, label, state after) of the least path of every run, in order."""
        _, marked = self.rank(entry)
        node = np.flatnonzero(marked & (self.label != END))
        place = node // 4
        node = node[np.lexsort((-self.cost.reshape(-1)[node], place))]      # inserts come before the row's own edit
        return node // 4, self.label[node], self.target[node] % 4


def _bounds(conv: pa.ChunkedArray | pa.Array) -> tuple[list, np.ndarray]:
    """Conversations of a block in order, and the bounds of their rows."""
    ids = conv.to_pylist()
    cut = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
    return [ids[k] for k in cut], np.array([*cut, len(ids)])


def _columns(block: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    block = block.sort_by("at")
    return block, np.array(block.column("initial").to_pylist(), dtype=object), block.column("fault").to_numpy()


_SUMMARY = "conv_id long, block long, costs array<long>, ranks array<long>"


def _summary(key: tuple, block: pa.Table) -> pa.Table:
    """The block's first and last conversation: cost and rank of the least audit
    from each state to each state, row by row of the 4 x 4 tables."""
    block, initial, fault = _columns(block)
    ids, cut = _bounds(block.column("conv_id"))
    ends = sorted({0, len(ids) - 1})
    rows = np.concatenate([np.tile(np.arange(cut[e], cut[e + 1]), 4) for e in ends])
    size = np.repeat([cut[e + 1] - cut[e] for e in ends], 4)
    exits = np.tile(np.where(np.eye(4, dtype=bool), 0, NONE), (len(ends), 1))
    paths = Paths(initial[rows], fault[rows], np.r_[0, np.cumsum(size)], exits, np.zeros(len(size), bool))
    rank, _ = paths.rank(np.full(len(size), -1))
    at = 4 * paths.first[:, None] + np.arange(4)                  # (end x exit, entry)
    costs, ranks = paths.cost.reshape(-1)[at], rank[at]
    return pa.table({
        "conv_id": pa.array([ids[e] for e in ends], pa.int64()), "block": pa.array([key[0].as_py()] * len(ends), pa.int64()),
        "costs": [costs[4 * k:4 * k + 4].T.reshape(-1).tolist() for k in range(len(ends))],
        "ranks": [ranks[4 * k:4 * k + 4].T.reshape(-1).tolist() for k in range(len(ends))]})


_CHAIN = "conv_id long, block long, entry int, exit int"


def _chain(blocks: pa.Table) -> pa.Table:
    """Entry and exit state of every block of one conversation; -1 as the exit of
    its last block."""
    blocks = blocks.sort_by("block")
    costs = np.array(blocks.column("costs").to_pylist(), np.int64).reshape(-1, 4, 4)
    ranks = np.array(blocks.column("ranks").to_pylist(), np.int64).reshape(-1, 4, 4)
    n = len(costs)
    rest = FINAL
    for _ in range(3):
        rest = np.minimum(rest, rest[SPOKEN] + INSERT)
    leave = np.zeros((n, 4), np.int64)
    for k in range(n - 1, -1, -1):
        total = np.minimum(costs[k] + rest, NONE)
        rest = total.min(1)
        leave[k] = np.where(total == rest[:, None], ranks[k], NONE).argmin(1)
    entry, state = np.zeros(n, np.int32), START
    for k in range(n):
        entry[k], state = state, leave[k, state]
    exits = np.r_[entry[1:], -1].astype(np.int32)
    return pa.table({"conv_id": blocks.column("conv_id"), "block": blocks.column("block"), "entry": entry, "exit": exits})


_SOLVED = ("conv_id long, block long, cost long, audit string, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "lines array<struct<at: long, sub: int, role: string, turn: long, named: string, fp: binary>>")
_LINE = pa.list_(pa.struct([("at", pa.int64()), ("sub", pa.int32()), ("role", pa.string()), ("turn", pa.int64()), ("named", pa.string()), ("fp", pa.binary())]))


def _solve(key: tuple, block: pa.Table, states: pa.Table) -> pa.Table:
    """Per conversation of the block: its part of cost and audit, fault counts,
    and the lines of the repaired text (kept, renamed or inserted)."""
    if not len(block):
        return pa.table({n: pa.array([], t) for n, t in zip(
            ["conv_id", "block", "cost", "audit", "blank", "duplicate", "truncated", "illegal", "first", "last", "lines"],
            [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), _LINE])})
    block, initial, fault = _columns(block)
    ids, cut = _bounds(block.column("conv_id"))
    runs = len(ids)
    entry, exits, inserts = np.zeros(runs, np.int64), np.tile(FINAL, (runs, 1)), np.ones(runs, bool)
    place_of = {c: k for k, c in enumerate(ids)}
    for c, e, x in zip(*(states.column(n).to_pylist() for n in ("conv_id", "entry", "exit"))):
        entry[place_of[c]] = e
        if x >= 0:
            exits[place_of[c]], inserts[place_of[c]] = np.where(np.arange(4) == x, 0, NONE), False
    paths = Paths(initial, fault, cut, exits, inserts)
    place, label, after = paths.edits(entry)
    run = np.searchsorted(paths.first, place, side="right") - 1
    row = paths.row[place]

    count = block.column("n").to_numpy()
    blank, dup = block.column("blank").to_numpy(zero_copy_only=False), block.column("seen").to_numpy(zero_copy_only=False)
    at, turn, role, fp = (block.column(n).to_pylist() for n in ("at", "turn", "role", "fp"))
    spent = np.array([0, DELETE, INSERT, KEEP, RENAME])[label]
    spent += np.where(((label == K) | (label == R)) & (fault[row] == CUT_OFF), TRUNCATED, 0) if len(fault) else 0
    parts, prices, lines = [[] for _ in range(runs)], np.bincount(run, spent, runs).astype(np.int64), [[] for _ in range(runs)]
    for k, p, code, state, i in zip(run.tolist(), place.tolist(), label.tolist(), after.tolist(), row.tolist()):
        parts[k].append(LABELS[code])
        spoken = "user" if state == AFTER_U else "assistant"
        if code == I:                  # before the row of this place, or after the last one
            where = at[i] if i >= 0 else at[cut[k + 1] - 1]
            lines[k].append((where, len(lines[k]), spoken, None, None, None))
            continue
        if code != D:
            lines[k].append((at[i], len(lines[k]), role[i] if code == K else spoken, turn[i], role[i], fp[i]))
        if count[i] > 1:
            parts[k].append("D" * int(count[i] - 1))
    more = np.add.reduceat(count - 1, cut[:-1])
    total = lambda x: np.add.reduceat(x.astype(np.int64), cut[:-1])
    pair = np.array([x + y for x, y in zip(initial[:-1], initial[1:])], dtype=object)
    apart = np.ones(len(initial), bool)
    if len(pair):
        apart[1:] = ~np.isin(pair.astype(str), ["su", "ua", "au"])
    apart[cut[:-1]] = False
    return pa.table({
        "conv_id": pa.array(ids, pa.int64()), "block": pa.array([key[0].as_py()] * runs, pa.int64()),
        "cost": prices + DELETE * more, "audit": ["".join(p) for p in parts],
        "blank": total(np.where(blank, count, 0)), "duplicate": total(np.where(blank, 0, count - ~dup)),
        "truncated": total(fault == CUT_OFF), "illegal": total(apart) + more,
        "first": [initial[k] for k in cut[:-1]], "last": [initial[k - 1] for k in cut[1:]],
        "lines": pa.array([[dict(zip(("at", "sub", "role", "turn", "named", "fp"), x)) for x in y] for y in lines], _LINE)})


# ------------------------------------------------------------------ the job

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of
    ``conv_id:turn`` picks for each row."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return conversations.filter(hit != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(hit == 3, 2).otherwise(1).cast("long").alias("copies"))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Null-safe equality of ``columns``."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[c])
    return out


def ordered_rows(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and text of ``rows`` (as from
    ``damage``), with count, fault and its place ``at`` in the order of all rows."""
    ending = F.rtrim(F.col("text"), F.lit(SPACE))
    light = (rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("fp"), (ending == "").alias("blank"),
                         F.substring(ending, -1, 1).isin(".", "!", "?").alias("ended"), "copies")
             .groupBy("conv_id", "turn", "role", "fp", "blank", "ended").agg(F.sum("copies").alias("n")))
    light = written(light)
    place = F.struct(F.col("turn").isNotNull(), "turn")
    earliest = light.groupBy("conv_id", "role", "fp").agg(F.min(place).alias("earliest")).alias("e")
    flagged = (light.alias("l").join(earliest, _same(light, earliest, "conv_id") & (F.col("l.role") == F.col("e.role")) & (F.col("l.fp") == F.col("e.fp")))
               .select("l.*", (F.struct(F.col("l.turn").isNotNull(), F.col("l.turn")) > F.col("e.earliest")).alias("seen")))
    fault = F.when(F.col("blank") | F.col("seen"), FORCED).when(~F.col("ended"), CUT_OFF).otherwise(FREE)
    keys = ["conv_id", "turn", "role", "fp"]
    return written(flagged.repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
                   .select(*keys, "n", "blank", "seen", fault.cast("int").alias("fault"), F.substring("role", 1, 1).alias("initial"),
                           F.monotonically_increasing_id().alias("at")))


def _hashes(lines: DataFrame) -> DataFrame:
    """SHA-256 per conversation of its lines joined by newlines, in one pass over
    sorted rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row(conv, h):
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        done: list[tuple] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if state is None or conv != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                                 names=["conv_id", "repaired_sha256"])
                done = []
        if state is not None:
            yield row(now, state)

    return (lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").select("conv_id", "role", "text")
            .mapInArrow(task, "conv_id long, repaired_sha256 string"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, lines) of ``rows`` (conv_id, turn, role, text, copies). Report: per
    conversation gaps, fault counts, cost, audit. Lines: the repaired rows as
    (conv_id, at, sub, role, text), in the order of at and sub."""
    bounded_batches(rows.sparkSession)
    ordered = ordered_rows(rows)
    blocks = ordered.withColumn("block", F.expr(f"at div {BLOCK}"))
    states = (blocks.groupBy("block").applyInArrow(_summary, _SUMMARY).groupBy("conv_id").applyInArrow(_chain, _CHAIN))
    solved = written(blocks.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(_solve, _SOLVED))

    turns = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    piece = F.array_sort(F.collect_list(F.struct("block", "audit", "first", "last")))
    report = (solved.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], piece.alias("p"))
              .withColumn("seams", F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda x, y: F.concat(x["last"], y["first"])))
              .select("conv_id", "blank", "duplicate", "truncated",
                      (F.col("illegal") + F.size(F.filter("seams", lambda s: ~s.isin("su", "ua", "au")))).alias("illegal"), "cost",
                      F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit")).alias("r"))
    turns = turns.alias("t")
    report = (report.join(turns, F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")))
              .select("r.conv_id", "t.gaps", *[f"r.{c}" for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]))

    line = solved.select("conv_id", F.inline("lines")).alias("k")
    texts = (rows.withColumn("fp", F.unhex(F.md5("text"))).groupBy("conv_id", "turn", "role", "fp").agg(F.first("text").alias("text"))).alias("x")
    lines = (line.join(texts, F.col("k.conv_id").eqNullSafe(F.col("x.conv_id")) & F.col("k.turn").eqNullSafe(F.col("x.turn"))
                       & (F.col("k.named") == F.col("x.role")) & (F.col("k.fp") == F.col("x.fp")), "left")
             .select("k.conv_id", "k.at", "k.sub", "k.role", F.coalesce("x.text", F.lit("")).alias("text")))
    return report, lines


def repair_conversations(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per conversation of ``conversations``: the report on ``rows`` and the hash
    of the repaired text."""
    report, lines = repair(rows)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("c")
    report, hashed = report.alias("r"), _hashes(lines).alias("h")
    empty = hashlib.sha256().hexdigest()
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c)
    return (every.join(report, F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(hashed, F.col("c.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
            .select("c.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("h.repaired_sha256", F.lit(empty)).alias("repaired_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return repair_conversations(conversations, damage(conversations))


#: A plain forward search that carries whole audits and texts.
ORACLE_SQL = """
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce([CAST(unicode(x) AS BIGINT) FOR x IN string_split(place, '')],
                lambda crc, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8],
                    lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
                CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS hit
  FROM named
), damaged AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed
), placed AS (
  SELECT *, md5(text) AS fp, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN ink = '' THEN 'b' WHEN seen THEN 'd' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         initial || coalesce(lead(initial) OVER (PARTITION BY conv_id ORDER BY pos), '-') AS pair, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS final
  FROM placed
), inserts(q, cost, audit, lines, r) AS (
  VALUES (0, 0, '', '', 0), (1, 0, '', '', 1), (2, 0, '', '', 2), (3, 0, '', '', 3),
         (0, 5, 'I', chr(10) || 'user:', 2), (1, 5, 'I', chr(10) || 'user:', 2), (3, 5, 'I', chr(10) || 'user:', 2), (2, 5, 'I', chr(10) || 'assistant:', 3),
         (0, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)
), edits(r, edit, cost, spoken, s, initial) AS (
  VALUES (0, 'D', 2, NULL, 0, NULL), (1, 'D', 2, NULL, 1, NULL), (2, 'D', 2, NULL, 2, NULL), (3, 'D', 2, NULL, 3, NULL),
         (0, 'K', 0, NULL, 1, 's'), (0, 'K', 0, NULL, 2, 'u'), (1, 'K', 0, NULL, 2, 'u'), (3, 'K', 0, NULL, 2, 'u'), (2, 'K', 0, NULL, 3, 'a'),
         (0, 'R', 1, 'user', 2, NULL), (1, 'R', 1, 'user', 2, NULL), (3, 'R', 1, 'user', 2, NULL), (2, 'R', 1, 'assistant', 3, NULL)
), paths(conv, pos, q, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} FROM (SELECT DISTINCT conv_id FROM faulty)
  UNION ALL
  SELECT p.conv, f.pos, e.s, min({'cost': p.best.cost + i.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END,
             'audit': p.best.audit || i.audit || e.edit,
             'lines': p.best.lines || i.lines || CASE WHEN e.edit = 'D' THEN '' ELSE chr(10) || coalesce(e.spoken, f.role) || ':' || f.text END})
  FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv AND f.pos = p.pos + 1
  JOIN inserts i ON i.q = p.q JOIN edits e ON e.r = i.r
  WHERE e.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.initial IS NULL OR e.initial = f.initial))
  GROUP BY p.conv, f.pos, e.s
), solved AS (
  SELECT p.conv, min({'cost': p.best.cost + i.cost, 'audit': p.best.audit || i.audit, 'lines': p.best.lines || i.lines}) AS best
  FROM paths p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv AND f.pos = p.pos AND f.final JOIN inserts i ON i.q = p.q
  WHERE i.r IN (0, 3) GROUP BY p.conv
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (NOT final AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(s.best.cost, 0) AS BIGINT) AS cost, coalesce(s.best.audit, '') AS audit,
       sha256(coalesce(substr(s.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv IS NOT DISTINCT FROM o.conv_id
"""
