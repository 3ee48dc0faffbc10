"""Repair of conversation structure: the cheapest edits that give roles of the form (s?(ua)+)?.

The edits of a conversation are paths through a lattice of (rows taken, state of the roles so far):
Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only way for a blank or repeated row),
Insert of an empty user or assistant row 3; a truncated row that stays adds 3.  A forward and a
reverse Dijkstra search run from both ends; once their heaps together cost more than the best
meeting, every crossing of that cost is known and the one with the least audit (the initials of the
edits) is taken.

Rows are numbered by one range sort.  A conversation is cut into segments of at most SEGMENT rows,
each searched for all pairs of states, and the segments are put together in order.  That is exact:
two audits of one segment between the same states at the same cost never begin with each other (the
longer one would end in inserts, which cost), so the least whole is made of least parts.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_BITS = 9
SEGMENT = 1 << SEGMENT_BITS            # rows searched at once
PART_SHIFT = 43                        # a position is the task's number and the place in its rows
CACHED_ROWS = 24                       # segments up to this length are remembered by their shape
WHITE = " \t\n\x0b\x0c\r"
#: Role state -> {initial: next state}; 0 nothing yet, 1 after s, 2 after a user, 3 after a pair.
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BACK = {z: [(a, r) for a, to in STEP.items() for r, y in to.items() if y == z] for z in STEP}
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}


def _row_edits(symbol: str, role: str):
    """(cost, edit) of leaving the row of a symbol with a role."""
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        if symbol.lower() == role:
            yield KEEP + extra, "K"
        if role != "s":
            yield REROLE + extra, "R"


def _forward(symbols: str, i: int, q: int):
    """Edges out of a node: (cost, edit, next node)."""
    for role, to in STEP[q].items():
        if role != "s":
            yield INSERT, "I", (i, to)
        if i < len(symbols):
            for cost, edit in _row_edits(symbols[i], role):
                yield cost, edit, (i + 1, to)
    if i < len(symbols):
        yield DELETE, "D", (i + 1, q)


def _reverse(symbols: str, i: int, q: int):
    for frm, role in BACK[q]:
        if role != "s":
            yield INSERT, "I", (i, frm)
        if i:
            for cost, edit in _row_edits(symbols[i - 1], role):
                yield cost, edit, (i - 1, frm)
    if i:
        yield DELETE, "D", (i - 1, q)


class _Search:
    """One direction of the search.  Nodes leave the heap by cost, then by rows taken: the edges
    that cost nothing take a row, so a node's label has its least audit when it leaves."""

    def __init__(self, symbols: str, start: tuple[int, int], ahead: bool):
        self.symbols, self.ahead = symbols, ahead
        self.labels = {start: (0, "")}
        self.heap = [(0, 0, start)]
        self.done: set = set()

    def least(self) -> float:
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def advance(self) -> list[tuple[int, int]]:
        """Settle the first node; the nodes whose labels changed."""
        cost, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        audit, changed = self.labels[node][1], []
        edges = _forward if self.ahead else _reverse
        for more, edit, to in edges(self.symbols, *node):
            label = (cost + more, audit + edit if self.ahead else edit + audit)
            if to not in self.done and (to not in self.labels or label < self.labels[to]):
                self.labels[to] = label
                taken = to[0] if self.ahead else len(self.symbols) - to[0]
                heapq.heappush(self.heap, (label[0], taken, to))
                changed.append(to)
        return changed


def cheapest_edits(symbols: str, start: int, goal: int) -> tuple[int, str] | None:
    """(cost, least audit) of the edits that lead from one role state to another over the rows, a
    symbol each: s, u, a or o (another role), capital if truncated, x if it must go; None if no
    edits do."""
    f = _Search(symbols, (0, start), True)
    r = _Search(symbols, (len(symbols), goal), False)
    best = 0 if not symbols and start == goal else float("inf")
    while f.least() + r.least() <= best and (f.heap and r.heap):
        own, other = (f, r) if f.least() <= r.least() else (r, f)
        for node in own.advance():
            if node in other.labels:
                best = min(best, own.labels[node][0] + other.labels[node][0])
    meet = [(f.labels[v][0] + r.labels[v][0], f.labels[v][1] + r.labels[v][1])
            for v in f.labels.keys() & r.labels.keys()]
    return min(meet) if meet else None


def all_paths(symbols: str) -> tuple:
    """(state before, state after, cost, audit) for all pairs of states that edits connect."""
    out = []
    for a in STEP:
        for z in STEP:
            found = cheapest_edits(symbols, a, z)
            if found:
                out.append((a, z, *found))
    return tuple(out)


@lru_cache(maxsize=1 << 14)
def known_paths(symbols: str) -> tuple:
    return all_paths(symbols)


def segment_paths(symbols: str) -> tuple:
    return (known_paths if len(symbols) <= CACHED_ROWS else all_paths)(symbols)


class _Chain:
    """Audits of the segments so far, shared with the other chains that begin alike."""

    __slots__ = ("before", "edits", "state")

    def __init__(self, before, edits, state):
        self.before, self.edits, self.state = before, edits, state


def _less(a: _Chain, b: _Chain) -> bool:
    """Whether chain a's audit is less than b's; both have the same number of segments."""
    left, right = [], []
    while a is not b:
        left.append(a.edits)
        right.append(b.edits)
        a, b = a.before, b.before
    return "".join(reversed(left)) < "".join(reversed(right))


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and _less(new[1], old[1])


def extend(states: dict, paths) -> dict:
    """Best (cost, chain) by role state after one more segment."""
    out: dict = {}
    for a, z, cost, edits in paths:
        if a in states:
            new = (states[a][0] + cost, _Chain(states[a][1], edits, a))
            if _better(new, out.get(z)):
                out[z] = new
    return out


def damage(rows: DataFrame) -> DataFrame:
    """The damaged copy of a conversations table, by crc32 of ``conv_id:turn`` modulo 20 (a null
    counts as one space, there and in role and text): 0 drops the row, 1 empties its text, 2 takes
    out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                      F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    made = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("again"))
    return made.drop("again")


def _number(batches):
    """Rows ordered by conversation -> with their position; a segment begins at a multiple of
    SEGMENT, with each conversation and after SEGMENT rows."""
    at, conv, seen = TaskContext.get().partitionId() << PART_SHIFT, None, False
    for x in batches:
        places = []
        for c in x.column(0).to_pylist():
            if seen and c != conv:
                at = (at + SEGMENT - 1) & -SEGMENT
            seen, conv = True, c
            places.append(at)
            at += 1
        yield pa.RecordBatch.from_arrays([*x.columns, pa.array(places, pa.int64())], [*x.schema.names, "pos"])


def numbered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, pos): all rows in order of turn (null first), role and text; pos
    ascends within a conversation and names the segment, pos >> SEGMENT_BITS."""
    small_batches(rows.sparkSession)
    head = F.substring("text", 1, 32)
    ordered = rows.repartitionByRange("conv", "turn", "role", head) \
        .sortWithinPartitions("conv", "turn", "role", "text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return cut(ordered.mapInArrow(_number, fields + ", pos long"), "conversations")


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
SEGMENTS = ("seg long, {conv}, blank long, duplicate long, truncated long, illegal long, n_turns long, "
            "turn_first long, turn_last long, turn_least long, role_first string, role_last string, "
            "paths array<struct<a:int,z:int,cost:long,edits:string>>")
PATHS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
LEGAL = {"su", "ua", "au"}


def _segments(conv_type: pa.DataType):
    """Rows (seg, pos, kind, conv, turn, initial, empty, cut_off) ordered by the first three, where
    a row of kind 0 says that the row of kind 1 at its place is the first of its text -> a row a
    segment."""
    kinds = [pa.int64(), conv_type, *[pa.int64()] * 8, pa.string(), pa.string(), PATHS]
    names = ["seg", "conv", *COUNTS, "n_turns", "turn_first", "turn_last", "turn_least", "role_first",
             "role_last", "paths"]

    def finish(seg, conv, rows):
        blank = sum(r[2] for r in rows)
        duplicate = sum(not r[2] and r[4] for r in rows)
        truncated = sum(not r[2] and not r[4] and r[3] for r in rows)
        illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(rows, rows[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        symbols = "".join(
            "x" if r[2] or r[4] else (r[1] if r[1] in ("s", "u", "a") else "o").upper() if r[3]
            else (r[1] if r[1] in ("s", "u", "a") else "o") for r in rows)
        paths = [{"a": a, "z": z, "cost": c, "edits": e} for a, z, c, e in segment_paths(symbols)]
        return (seg, conv, blank, duplicate, truncated, illegal, len(set(turns)), turns[0] if turns else None,
                turns[-1] if turns else None, min(turns) if turns else None, rows[0][1], rows[-1][1], paths)

    def run(batches):
        seg = conv = first = None
        rows: list = []
        for x in batches:
            out = []
            for s, pos, kind, c, turn, initial, empty, cut_off in zip(*(col.to_pylist() for col in x.columns)):
                if s != seg:
                    if rows:
                        out.append(finish(seg, conv, rows))
                    seg, rows = s, []
                if kind == 0:
                    first = pos
                else:
                    conv = c
                    rows.append((turn, initial, empty, cut_off, pos != first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in
                                              zip(finish(seg, conv, rows), kinds)], names)
    return run


CHOSEN = ("{conv}, seg long, state int, edits string, gaps long, blank long, duplicate long, truncated long, "
          "illegal long, cost long")


def _choose(conv_type: pa.DataType):
    """Segments ordered by (conv, seg) -> for every conversation its report (seg null) and, for
    every segment, the state it begins with and its edits."""
    kinds = [conv_type, pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6]
    names = ["conv", "seg", "state", "edits", "gaps", *COUNTS, "cost"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def finish(conv, segs, states, total, gaps):
        cost, chain = None, None
        for z in FINAL:
            if z in states and _better(states[z], None if cost is None else (cost, chain)):
                cost, chain = states[z]
        pieces = []
        while chain is not None and chain.before is not None:
            pieces.append((chain.state, chain.edits))
            chain = chain.before
        pieces.reverse()
        audit = "".join(e for _, e in pieces)
        yield (conv, None, None, audit, gaps, *total, cost)
        for s, (state, edits) in zip(segs, pieces):
            yield (conv, s, state, edits, *[None] * 6)

    def run(batches):
        conv, open_, out = None, False, []
        segs = states = total = None
        low = high = last_role = None
        distinct = 0

        def close():
            gaps = 0 if low is None else high - low + 1 - distinct
            return finish(conv, segs, states, total, gaps)

        for x in batches:
            for (seg, c, b, d, t, i, n, first, last, least, role_first, role_last, paths) in \
                    zip(*(col.to_pylist() for col in x.columns)):
                if not open_ or c != conv:
                    if open_:
                        for row in close():
                            out.append(row)
                            if len(out) >= 1000:
                                yield batch(out)
                                out = []
                    conv, open_ = c, True
                    segs, states, total = [], {0: (0, _Chain(None, "", 0))}, [0, 0, 0, 0]
                    low = high = last_role = None
                    distinct = 0
                segs.append(seg)
                states = extend(states, [(p["a"], p["z"], p["cost"], p["edits"]) for p in paths])
                total = [u + v for u, v in zip(total, (b, d, t, i))]
                if last_role is not None and last_role + role_first not in LEGAL:
                    total[3] += 1
                last_role = role_last
                if first is not None:
                    distinct += n - (high == first)
                    low, high = (least if low is None else low), last
        if open_:
            for row in close():
                out.append(row)
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)
    return run


def _edited(batches):
    """Rows (conv, seg, kind, pos, turn, role, text, state, edits) ordered by the first four, where a
    row of kind 0 brings a segment's edits -> (conv, turn, role, text, edit) of what stays, in order;
    a conversation begins with a row whose edit is None."""
    conv, open_ = None, False
    edits, at, state = "", 0, 0

    def inserts():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            role = "a" if state == 2 else "u"
            state = STEP[state][role]
            at += 1
            yield (conv, None, NAMES[role], "", "I")

    for x in batches:
        for c, _, kind, _, turn, role, text, begin, own in zip(*(col.to_pylist() for col in x.columns)):
            if kind == 0:
                yield from inserts()
                if not open_ or c != conv:
                    conv, open_ = c, True
                    yield (conv, None, None, None, None)
                edits, at, state = own, 0, begin
                continue
            yield from inserts()
            edit = edits[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = NAMES["a" if state == 2 else "u"]
            state = STEP[state][role[:1]]
            yield (conv, turn, role, text, edit)
    yield from inserts()


def _digests(conv_type: pa.DataType):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], conv_type),
                                           pa.array([r[1] for r in rows], pa.string())], ["conv", "sha"])

    def run(batches):
        out, conv, h = [], None, None
        for c, _, role, text, edit in _edited(batches):
            if edit is None:
                if h is not None:
                    out.append((conv, h.hexdigest()))
                    if len(out) >= 1000:
                        yield batch(out)
                        out = []
                conv, h, more = c, hashlib.sha256(), False
                continue
            if more:
                h.update(b"\n")
            h.update(role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
            more = True
        if h is not None:
            out.append((conv, h.hexdigest()))
        if out:
            yield batch(out)
    return run


def _rows(conv_type: pa.DataType):
    kinds = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = ["conv", "place", "turn", "role", "text", "edit"]

    def run(batches):
        out, size, place = [], 0, 0
        for c, turn, role, text, edit in _edited(batches):
            if edit is None:
                place = 0
                continue
            out.append((c, place, turn, role, text, edit))
            place, size = place + 1, size + len(text)
            if len(out) >= 1000 or size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
    return run


def chosen_edits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered rows, chosen edits) of rows (conv, turn, role, text) without null roles and texts."""
    rows = numbered(rows)
    seg = F.shiftright("pos", SEGMENT_BITS).alias("seg")
    conv = rows.schema["conv"]
    conv_type = pa.int64() if conv.dataType.simpleString() == "bigint" else pa.string()
    conv_ddl = f"conv {conv.dataType.simpleString()}"
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    firsts = rows.groupBy("conv", F.sha2(whole, 256).alias("print")).agg(F.min("pos").alias("pos"))
    end = F.rtrim("text", F.lit(WHITE))
    light = rows.select(seg, "pos", F.lit(1).alias("kind"), "conv", F.col("turn").cast("long").alias("turn"),
                        F.substring("role", 1, 1).alias("initial"), (end == "").alias("empty"),
                        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut_off"))
    marks = firsts.select(seg, "pos", F.lit(0).alias("kind"), *[F.lit(None).cast(light.schema[c].dataType).alias(c)
                                                              for c in light.columns[3:]])
    ordered = light.unionByName(marks).repartition("seg").sortWithinPartitions("seg", "pos", "kind")
    segments = ordered.mapInArrow(_segments(conv_type), SEGMENTS.format(conv=conv_ddl))
    chosen = segments.repartition("conv").sortWithinPartitions("conv", "seg") \
        .mapInArrow(_choose(conv_type), CHOSEN.format(conv=conv_ddl))
    return rows, cut(chosen, "conversations")


def _with_edits(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    seg = F.shiftright("pos", SEGMENT_BITS).alias("seg")
    own = rows.select("conv", seg, F.lit(1).alias("kind"), "pos", F.col("turn").cast("long").alias("turn"), "role",
                      "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("edits"))
    edits = chosen.where("seg is not null").select(
        "conv", "seg", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"), "state", "edits")
    return edits.unionByName(own).repartition("conv").sortWithinPartitions("conv", "seg", "kind", "pos")


def _input(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                       F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" ")).alias("text"))


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the repaired conversations, a row a row that stays or
    is inserted (turn null), in places from 0.  See repair_report for what counts as what."""
    own, chosen = chosen_edits(_keyed(_input(rows, conv_col, turn_col, role_col, text_col)))
    conv = own.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv == "bigint" else pa.string()
    return _with_edits(own, chosen).mapInArrow(
        _rows(kind), f"conv {conv}, place long, turn long, role string, text string, edit string") \
        .withColumnRenamed("conv", "conv_id")


def _keyed(rows: DataFrame) -> DataFrame:
    """Conversation ids as long if they are whole numbers, else as text."""
    whole = rows.schema["conv"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return rows.withColumn("conv", F.col("conv").cast("long" if whole else "string"))


def repair_report(rows: DataFrame, original: DataFrame | None = None, conv_col: str = "conv_id",
                  turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a
    conversation of ``original`` (of the rows, if not given).

    Rows are taken by turn, null first, then role and text.  The first fault of a row counts: blank
    (only white space; a null text counts as one space), duplicate (role and text seen earlier in the
    conversation), truncated (the last character that is no white space isn't one of .!?).  Gaps are
    the turns missing between the least and the greatest; illegal counts neighbouring rows whose role
    initials are not su, ua or au.  A null or empty role can't be kept.  Null conversation ids are one
    conversation; extra columns are not looked at; an empty table gives none; a conversation of
    ``original`` without rows has zeros, an empty audit and the hash of nothing.

    The digest reads a conversation's whole text in order, so one task streams it; nothing of it
    but its audit is held in memory.
    """
    own, chosen = chosen_edits(_keyed(_input(rows, conv_col, turn_col, role_col, text_col)))
    conv = own.schema["conv"].dataType.simpleString()
    kind = pa.int64() if conv == "bigint" else pa.string()
    digest = _with_edits(own, chosen).mapInArrow(_digests(kind), f"conv {conv}, sha string") \
        .toDF("_digest_conv", "sha")
    told = chosen.where("seg is null").withColumnRenamed("conv", "_told_conv")
    whole = _keyed((rows if original is None else original).select(F.col(f"`{conv_col}`").alias("conv"))).distinct()
    zero = F.lit(0).cast("long")
    joined = whole.join(told, F.col("conv").eqNullSafe(F.col("_told_conv")), "left") \
        .join(digest, F.col("conv").eqNullSafe(F.col("_digest_conv")), "left")
    return joined.select(F.col("conv").alias("conv_id"),
                         *[F.coalesce(c, zero).alias(c) for c in ("gaps", *COUNTS, "cost")],
                         F.coalesce("edits", F.lit("")).alias("audit"),
                         F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged_report(rows: DataFrame) -> DataFrame:
    return repair_report(damage(rows), rows)
