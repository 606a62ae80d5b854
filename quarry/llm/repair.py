"""Conversation structure repair by Hirschberg divide and conquer.

A sound conversation has the role initials ``(s?(ua)+)?``: four states (start,
after s, after u, after a; start and after a may end it).  Rows are kept (0),
get the role user or assistant (``R``, 1), are deleted (``D``, 2), or empty user
or assistant rows are inserted anywhere (``I``, 5).  Blank rows and repetitions
of an earlier row must be deleted; a truncated row that stays adds 5.  Of the
cheapest edits those with the ASCII-least audit (their initials in order) are
taken.

1. Rows are put in order by a range sort, which gives each a position, and cut
   into blocks of at most ``BLOCK`` rows of one conversation.
2. A repetition is found in two steps: within its block, then among the first
   occurrences of the blocks.
3. Forward, four cost vectors (one for each state that a block may start in) go
   over a block's rows; with each cost goes the rank of its audit among the four,
   since audits that reach different states differ before either ends.  They make
   the block one step, a 4 x 4 table of (cost, audit rank).
4. Over a conversation's blocks, then over each block's rows between the states
   found for its ends, the same recursion runs: the forward vector of the first
   half meets the backward vector of the second in the middle, the cheapest state
   (of equal ones that with the least forward audit) is crossed, and both halves
   go on alone.  Only states at borders are kept, so space is linear.

Vectors, less their smallest cost, are few, so steps over rows are looked up.

Scale.  Texts are sorted once and joined to their edits by position.  A
conversation of any length is spread over blocks; its list of blocks (one entry
for at most 4,096 rows) is the largest thing a task holds.  ``report`` reads a
conversation's rows one after the other in one task, a batch at a time, as a
SHA-256 can't be computed otherwise; its audit is one value.

Defined cases: null roles and texts read as one space; a null conversation id
is a conversation; null turns come first; rows of equal turn go by role, then
md5 of the text; a role is known by its first character, others than s, u, a
can't be kept; repeated rows are repetitions; an empty table gives an empty
result.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import with_uid, written

BLOCK = 4096
SPACE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
KEPT, RENAMED, DELETED, INSERTED, UNFINISHED = 0, 1, 2, 5, 5  # costs
OK, TRUNCATED, DOOMED = 0, 1, 2  # classes of rows
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FOLLOWS = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state behind the one user or assistant row that may come
NAME = {AFTER_U: "u", AFTER_A: "a"}
ALLOWED = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}

Moves = list[list[tuple]]  # for each state: (state behind the step, cost, order of its audit)


def _row_moves(initial: str, kind: int) -> Moves:
    """The cheapest letters from state to state over one row of that kind."""
    table: Moves = []
    for q in range(4):
        best: dict[int, tuple] = {}
        at, letters = q, ""
        for _ in range(3):  # more insertions come back to a state
            ends = [(at, DELETED, "D")]
            if kind != DOOMED:
                late = UNFINISHED if kind == TRUNCATED else 0
                ends.append((FOLLOWS[at], RENAMED + late, "R"))
                if (at, initial) in ALLOWED:
                    ends.append((ALLOWED[at, initial], KEPT + late, "K"))
            for to, cost, letter in ends:
                got = (cost + INSERTED * len(letters), letters + letter)
                best[to] = min(best.get(to, got), got)
            at, letters = FOLLOWS[at], letters + "I"
        table.append([(to, cost, text) for to, (cost, text) in best.items()])
    return table


ROWS: list[Moves] = [_row_moves(i, k) for i in "sua?" for k in (OK, TRUNCATED, DOOMED)]
# behind the last row: what is missing is inserted, all lead to state START
FINISH: Moves = [[(START, 0, "")], [(START, 2 * INSERTED, "II")], [(START, INSERTED, "I")], [(START, 0, "")]]

Vector = tuple  # of (cost, audit rank), None where a state is out of reach


def advance(vector: Vector, moves: Moves) -> Vector:
    best: dict[int, tuple] = {}
    for q, x in enumerate(vector):
        if x is not None:
            for to, cost, order in moves[q]:
                got = (x[0] + cost, (x[1], order))
                if to not in best or got < best[to]:
                    best[to] = got
    ranks = {o: i for i, o in enumerate(sorted(o for _, o in best.values()))}
    return tuple((best[q][0], ranks[best[q][1]]) if q in best else None for q in range(4))


def retreat(costs: tuple, moves: Moves) -> tuple:
    """Costs to the end from each state before the step."""
    return tuple(min((c + costs[to] for to, c, _ in moves[q] if costs[to] is not None), default=None) for q in range(4))


class Walk:
    """Forward and backward vectors over steps; steps over rows (numbers into
    ``ROWS``) are looked up by the vector less its smallest cost."""

    def __init__(self):
        self.ahead: dict = {}
        self.back: dict = {}

    def forward(self, steps, lo: int, hi: int, q: int) -> Vector:
        v, base = tuple((0, 0) if s == q else None for s in range(4)), 0
        for k in steps[lo:hi]:
            if isinstance(k, int):
                got = self.ahead.get((v, k))
                if got is None:
                    new = advance(v, ROWS[k])
                    low = min(x[0] for x in new if x)
                    got = self.ahead[v, k] = (tuple(x and (x[0] - low, x[1]) for x in new), low)
                v, base = got[0], base + got[1]
            else:
                v = advance(v, k)
        return tuple(x and (x[0] + base, x[1]) for x in v)

    def backward(self, steps, lo: int, hi: int, q: int) -> tuple:
        v, base = tuple(0 if s == q else None for s in range(4)), 0
        for k in reversed(steps[lo:hi]):
            if isinstance(k, int):
                got = self.back.get((v, k))
                if got is None:
                    new = retreat(v, ROWS[k])
                    low = min(x for x in new if x is not None)
                    got = self.back[v, k] = (tuple(x if x is None else x - low for x in new), low)
                v, base = got[0], base + got[1]
            else:
                v = retreat(v, k)
        return tuple(x if x is None else x + base for x in v)

    def states(self, steps, q_in: int, q_out: int) -> list[int]:
        """The states at all borders of the best way from q_in to q_out."""
        out = [q_in] + [0] * (len(steps) - 1) + [q_out]
        todo = [(0, len(steps))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            left, right = self.forward(steps, lo, mid, out[lo]), self.backward(steps, mid, hi, out[hi])
            out[mid] = min((left[q][0] + right[q], left[q][1], q) for q in range(4) if left[q] is not None and right[q] is not None)[2]
            todo += [(lo, mid), (mid, hi)]
        return out


def table_of(walk: Walk, steps) -> Moves:
    """A whole block as one step."""
    return [[(to, *x) for to, x in enumerate(walk.forward(steps, 0, len(steps), q)) if x] for q in range(4)]


def _letters(moves: Moves, q: int, to: int) -> str:
    return next(text for t, _, text in moves[q] if t == to)


def row_edits(steps, states: list[int]) -> list[tuple[str, str, str]]:
    """(letters, initials of the rows inserted before, what becomes of the row:
    its own role ``k``, ``u``, ``a`` or ``d``eleted) of each row."""
    out = []
    for k, q, to in zip(steps, states, states[1:]):
        letters, before = _letters(ROWS[k], q, to), ""
        for _ in letters[:-1]:
            q = FOLLOWS[q]
            before += NAME[q]
        out.append((letters, before, {"K": "k", "D": "d", "R": NAME.get(FOLLOWS[q])}[letters[-1]]))
    return out


def finish(q: int) -> str:
    """Initials of the rows inserted behind the last one."""
    out = ""
    for _ in FINISH[q][0][2]:
        q = FOLLOWS[q]
        out += NAME[q]
    return out


# Faults and codes: a row's code is 4 * (place of its initial in "sua?") + fault.
FAULTS = ("none", "blank", "duplicate", "truncated")
_CLASS = (OK, DOOMED, DOOMED, TRUNCATED)


def _steps(codes: list[int]) -> list[int]:
    return [c // 4 * 3 + _CLASS[c % 4] for c in codes]


_SOUND = {(0, 1), (1, 2), (2, 1)}


def _summaries(batches):
    """A block's table as numbers (state behind, cost, rank; so many for each
    state before), its unsound neighbours, and the initials at its ends."""
    walk = Walk()
    for b in batches:
        flat, lines, illegal, head, tail = [], [], [], [], []
        for codes in b.column("codes").to_pylist():
            table = table_of(walk, _steps(codes))
            flat.append([x for q in table for cell in q for x in cell])
            lines.append([len(q) for q in table])
            first = [c // 4 for c in codes]
            illegal.append(sum(p not in _SOUND for p in zip(first, first[1:])))
            head.append(first[0])
            tail.append(first[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("first"), pa.array(flat, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.int64())),
             *(pa.array(c, pa.int64()) for c in (illegal, head, tail))],
            names=["conv_id", "first", "moves", "lines", "illegal", "head", "tail"])


def _moves_of(flat: list[int], lines: list[int]) -> Moves:
    cells = [tuple(flat[i:i + 3]) for i in range(0, len(flat), 3)]
    out, at = [], 0
    for n in lines:
        out.append(cells[at:at + n])
        at += n
    return out


def _crossings(batches):
    """A conversation's list of blocks -> the states at their borders."""
    walk = Walk()
    bound = pa.list_(pa.struct([("first", pa.int64()), ("q_in", pa.int32()), ("q_out", pa.int32()), ("after", pa.string())]))
    for b in batches:
        bounds, costs, illegal = [], [], []
        for blocks in b.column("blocks").to_pylist():
            steps = [_moves_of(x["moves"], x["lines"]) for x in blocks] + [FINISH]
            states = walk.states(steps, START, START)
            costs.append(sum(next(c for to, c, _ in m[q] if to == t) for m, q, t in zip(steps, states, states[1:])))
            illegal.append(sum(x["illegal"] for x in blocks)
                           + sum((x["tail"], y["head"]) not in _SOUND for x, y in zip(blocks, blocks[1:])))
            bounds.append([{"first": x["first"], "q_in": q, "q_out": to, "after": ""} for x, q, to in zip(blocks, states, states[1:])])
            bounds[-1][-1]["after"] = finish(states[-2])
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(bounds, bound)],
            names=["conv_id", "cost", "illegal", "bounds"])


def _edits(batches):
    walk = Walk()
    one = pa.list_(pa.struct([("letters", pa.string()), ("before", pa.string()), ("own", pa.string()), ("after", pa.string())]))
    for b in batches:
        rows = []
        for codes, q, to, after in zip(*(b.column(c).to_pylist() for c in ("codes", "q_in", "q_out", "after"))):
            steps = _steps(codes)
            got = [{"letters": x, "before": y, "own": z, "after": ""} for x, y, z in row_edits(steps, walk.states(steps, q, to))]
            got[-1]["letters"] += "I" * len(after)
            got[-1]["after"] = after
            rows.append(got)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("first"), pa.array(rows, one)], names=["conv_id", "first", "edits"])


def ordered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, role, text, pos, blk of every row (written): ``pos`` rises
    through each conversation, ``blk`` numbers its blocks."""
    key = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.md5("text"), "q_uid", "copy"]
    put = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return written(put.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))
                   .withColumn("blk", F.floor(F.col("pos") / block)), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, blk, pos, code of every ordered row."""
    at = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))  # an empty role is in place 1, so it is asked for
    initial = F.when((F.col("role") == "") | (at == 0), len(INITIALS)).otherwise(at - 1)
    end = F.rtrim("text", F.lit(SPACE))
    same = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")))
    narrow = rows.select("conv_id", "blk", "pos", same.alias("same"), initial.alias("initial"), (end == "").alias("blank"),
                         (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    here = F.row_number().over(Window.partitionBy("conv_id", "blk", "same").orderBy("pos"))
    among = F.when(F.col("here") == 1, F.lit(-1)).otherwise(F.col("blk"))
    told = narrow.withColumn("here", here).withColumn("among", among)
    first = F.row_number().over(Window.partitionBy("conv_id", "same", "among").orderBy("pos"))
    fault = (F.when(F.col("blank"), 1).when((F.col("here") > 1) | (first > 1), 2).when(F.col("cut"), 3).otherwise(0))
    return told.select("conv_id", "blk", "pos", (F.col("initial") * 4 + fault).cast("int").alias("code"))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ordered rows: (conversations with cost and illegal, blocks with the
    edits of their rows), both written."""
    kind = dict(rows.dtypes)["conv_id"]
    cell = F.struct("pos", "code")
    blocks = written(faults(rows).groupBy("conv_id", "blk").agg(F.array_sort(F.collect_list(cell)).alias("c"))
                     .select("conv_id", F.col("c")[0]["pos"].alias("first"), F.transform("c", lambda x: x["code"]).alias("codes")), "blocks")
    tables = blocks.mapInArrow(_summaries, f"conv_id {kind}, first long, moves array<long>, lines array<long>, illegal long, head long, tail long")
    lists = tables.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "moves", "lines", "illegal", "head", "tail"))).alias("blocks"))
    whole = written(lists.mapInArrow(_crossings, f"conv_id {kind}, cost long, illegal long, "
                                                 "bounds array<struct<first:bigint,q_in:int,q_out:int,after:string>>"), "crossings")
    bounds = whole.select(F.explode("bounds").alias("x")).select("x.*")
    edits = written(blocks.join(bounds, "first").select("conv_id", "first", "codes", "q_in", "q_out", "after").mapInArrow(
        _edits, f"conv_id {kind}, first long, edits array<struct<letters:string,before:string,own:string,after:string>>"), "edits")
    faulty = lambda n: F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + (c % 4 == n).cast("long"))
    counts = blocks.groupBy("conv_id").agg(*[F.sum(faulty(i)).alias(FAULTS[i]) for i in (1, 2, 3)])
    per = whole.select("conv_id", "cost", "illegal").join(
        counts.withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other"))).drop("other")
    return per, edits


def applied(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, pos, turns (array of role, text, edit) of every ordered row: the
    row, if it stays, between the rows inserted around it."""
    each = edits.select(F.col("first"), F.posexplode("edits").alias("i", "e")).select((F.col("first") + F.col("i")).alias("pos"), "e.*")
    name = lambda x: F.when(x == "u", "user").otherwise("assistant")
    turn = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    added = lambda s: F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: turn(name(x), F.lit(""), "insert"))
    own = (F.when(F.col("own") == "k", F.array(turn(F.col("role"), F.col("text"), "keep")))
           .when(F.col("own") == "d", F.array().cast("array<struct<role:string,text:string,edit:string>>"))
           .otherwise(F.array(turn(name(F.col("own")), F.col("text"), "rerole"))))
    return rows.join(each, "pos").select("conv_id", "pos", F.concat(added(F.col("before")), own, added(F.col("after"))).alias("turns"))


def _source(convs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return with_uid(convs.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                 space(role_col).alias("role"), space(text_col).alias("text")), "q_uid")


def repair(convs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK) -> DataFrame:
    """The rows of the repaired conversations: conv_id, place (rising), sub
    (inserted rows share a place), role, text, edit (keep, rerole, insert)."""
    rows = ordered(_source(convs, id_col, turn_col, role_col, text_col).withColumn("copy", F.lit(0)), block)
    _, edits = plan(rows)
    return (applied(rows, edits).select("conv_id", F.col("pos").alias("place"), F.posexplode("turns").alias("sub", "t"))
            .select("conv_id", "place", "sub", "t.role", "t.text", "t.edit"))


def _digests(batches):
    """Rows by conversation and position -> SHA-256 of each conversation's
    lines; only the running hash goes from batch to batch."""
    conv, running, kind = None, None, None
    empty = True

    def out(rows):
        ids, hashes = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])

    for b in batches:
        kind, done = b.schema.field("conv_id").type, []
        for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
            if running is None or c != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running, empty = c, hashlib.sha256(), True
            if line is not None:
                running.update(line if empty else b"\n" + line)
                empty = False
        yield out(done)
    if running is not None:
        yield out([(conv, running.hexdigest())])


def report(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 of every id in ``convs`` (a table with conv_id); ``rows``
    has conv_id, turn, role, text (no nulls in the last two), q_uid and copy,
    which order equal rows."""
    put = ordered(rows, block)
    kind = dict(put.dtypes)["conv_id"]
    per, edits = plan(put)
    span = put.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("n"))
    gaps = span.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("n"), F.lit(0)).alias("gaps"))
    letters = F.array_join(F.transform("edits", lambda e: e["letters"]), "")
    audits = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", letters.alias("x")))).alias("p")).select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["x"]), "").alias("audit"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").cast("binary")
    lines = applied(put, edits).select("conv_id", "pos", F.when(F.size("turns") > 0, line).alias("line"))
    hashes = (lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "line")
              .mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string"))
    out = convs.select("conv_id").distinct()
    for part in (gaps, per, audits, hashes):
        out = out.join(part.withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
