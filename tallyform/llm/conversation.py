"""Repair of conversation structure by the cheapest edits, as a time-major tensor program.

A conversation should be an optional system turn and then pairs of user and assistant. Rows become
narrow codes (role, fault), are put in order by a range sort, so that one long conversation spreads over many
tasks, and are gathered into segments of at most 2^SEGMENT_BITS rows. NumPy takes the segments in buckets of
similar length and updates the costs of the four states of all segments of a bucket turn by turn,
backwards; the stored costs let the edits of all segments be traced forwards, again turn by turn.

A conversation of several segments is put together by its segments' cost tables: four costs from each of four
states, then the state in which each segment is entered. So no task holds more than a segment's rows of one
conversation, and of a conversation as a whole only a few numbers a segment. Texts move once, to meet their
edits in order; they are replayed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a segment, as a power of two, and cells (segments x turns) whose costs are held at once.
SEGMENT_BITS, CELLS = 10, 1 << 17

#: Cost of an inserted, a reroled and a deleted row, and of keeping or reroling a truncated one.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 40

# States: nothing yet, after system, after user, after assistant. Kept rows lead on by their role (system, user,
# assistant, other: no way from there is -1); an inserted or reroled row can only be the one role that fits.
BY_ROLE = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
ONWARD = np.array([2, 2, 3, 2])
ACCEPTED = np.array([0, FAR, FAR, 0], np.int64)
ROLES = ("user", "user", "assistant", "user")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of `conv_id:turn`, modulo 20, deals.

    0 drops the row, 1 empties its text, 2 takes out its [.!?], 3 repeats it, 4 makes it the user's. A null role or text
    is one space, and so is a null conv_id or turn in the key.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("deal")).where("deal <> 0")
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("deal") == 4, "user").otherwise(F.col("role"))
    twice = F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(twice).alias("copy")).drop("copy")


# ---------------------------------------------------------------- order and faults

_ORDER = ("turn", "role", "head", "hash")


def _keyed(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.substring(text, 1, 64).alias("head"), F.unhex(F.md5(text.cast("binary"))).alias("hash"), text.alias("text"))


def _segments(rows: DataFrame) -> DataFrame:
    """One row a segment: conv_id, chunk, rows (pos, code and the order columns, by pos) and counts. code is 4 * fault + role."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    coded = _keyed(rows).select("conv_id", *_ORDER, role.alias("initial"), blank.alias("blank"), truncated.alias("truncated"))
    order = ["conv_id", *_ORDER]
    placed = materialize(coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "turns")
    first = placed.where("NOT blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    flagged = placed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")) & ~F.col("blank"), "left")
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("truncated"), 3).otherwise(0)
    flagged = flagged.select("conv_id", "pos", "turn", "role", "head", "hash", fault.alias("fault"), (4 * fault + F.col("initial")).alias("code"))
    counts = [F.count_if(F.col("fault") == i).alias(n) for i, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    whole = F.array_sort(F.collect_list(F.struct("pos", "code", "turn", "role", "head", "hash")))
    return flagged.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("chunk")).agg(whole.alias("rows"), *counts)


def _wrong(before: Column, after: Column) -> Column:
    """Whether two adjacent rows' initials are none of su, ua, au."""
    return ~F.concat(before.cast("string"), after.cast("string")).isin("01", "12", "21")


def _counts(segments: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated and illegal of every conversation, from counts of segments and of their borders."""
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    roles = F.transform("rows", lambda r: r["code"] % 4)
    within = F.size(F.filter(F.zip_with(F.slice(roles, 1, F.size(roles) - 1), F.slice(roles, 2, F.size(roles)), _wrong), lambda x: x))
    ends = [F.element_at(a, i).alias(n) for a, i, n in ((F.col("roles"), 1, "first_role"), (F.col("roles"), -1, "last_role"))]
    turn = [F.element_at(F.transform("rows", lambda r: r["turn"]), i).alias(n) for i, n in ((1, "first_turn"), (-1, "last_turn"))]
    parts = segments.select("conv_id", "chunk", "blank", "duplicate", "truncated", roles.alias("roles"), within.alias("illegal"), F.size(F.array_distinct(turns)).alias("turns"), F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), *turn)
    parts = parts.select("*", *ends).drop("roles")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
    border = F.struct("chunk", "first_role", "last_role", "first_turn", "last_turn")
    whole = parts.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(border)).alias("b"))
    pairs = F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b")), lambda x, y: F.struct(_wrong(x["last_role"], y["first_role"]).alias("wrong"), F.coalesce(x["last_turn"] == y["first_turn"], F.lit(False)).alias("shared")))
    whole = whole.withColumn("pairs", pairs)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns") + F.size(F.filter("pairs", lambda p: p["shared"])), F.lit(0))
    illegal = F.col("illegal") + F.size(F.filter("pairs", lambda p: p["wrong"]))
    return whole.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"))


# ---------------------------------------------------------------- costs


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs of the states (second axis) where rows may be inserted first."""
    c0, c1, c2, c3 = (cost[:, i] for i in range(4))
    two, three = np.minimum(c2, INSERT + c3), np.minimum(c3, INSERT + c2)
    return np.minimum(np.stack([np.minimum(c0, INSERT + two), np.minimum(c1, INSERT + two), two, three], 1), FAR)


def backward(codes: np.ndarray, lens: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, segment, state, ...] of the rows from t on and what follows them; codes is turns x segments, end segments x states x ..."""
    turns, n = codes.shape
    wide = end.reshape(n, 4, -1)
    costs = np.empty((turns + 1, *wide.shape), np.int64)
    costs[turns] = _closed(wide)
    fault, role = codes // 4, codes % 4
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        to = BY_ROLE[role[t]]
        keep = np.where(to[:, :, None] >= 0, np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), FAR)
        stay = np.minimum(keep, REROLE + after[:, ONWARD]) + np.where(fault[t] == 3, TRUNCATED, 0)[:, None, None]
        stay[(fault[t] == 1) | (fault[t] == 2)] = FAR
        costs[t] = np.where((t < lens)[:, None, None], _closed(np.minimum(stay, DELETE + after)), after)
    return costs.reshape(turns + 1, *end.shape)


def forward(codes: np.ndarray, lens: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(op, inserted, entered, state): the least edits in order among the cheapest, their letters compared as ASCII.

    op[t] is D, K or R, inserted[t] the number of rows put in before row t, entered[t] the state before them; state is the one at the end.
    Row len of a last segment stands for the end, before which rows may still be put in; elsewhere that is the next segment's choice.
    """
    turns, n = codes.shape
    fault, role = codes // 4, codes % 4
    op, inserted, entered = (np.zeros((turns + 1, n), np.uint8) for _ in range(3))
    at, state = np.arange(n), state.copy()
    for t in range(turns + 1):
        row = t < lens
        entered[t] = state
        nxt = min(t + 1, turns)
        for _ in range(3):
            now = costs[t, at, state]
            drop = row & (DELETE + costs[nxt, at, state] == now)
            more = (row | (t == lens) & last) & ~drop & (INSERT + costs[t, at, ONWARD[state]] == now)
            inserted[t] += more
            state = np.where(more, ONWARD[state], state)
        if t == turns:
            break
        now = costs[t, at, state]
        drop = row & (DELETE + costs[nxt, at, state] == now)
        to = BY_ROLE[role[t], state]
        stays = (fault[t] != 1) & (fault[t] != 2) & row & ~drop
        keep = stays & (to >= 0) & (costs[nxt, at, np.maximum(to, 0)] + np.where(fault[t] == 3, TRUNCATED, 0) == now)
        op[t] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
        state = np.where(~row | drop, state, np.where(keep, to, ONWARD[state]))
    return op, inserted, entered, state


def buckets(lens: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of segments of similar length: the longest less than twice the shortest, CELLS cells at most or one segment."""
    order = np.argsort(lens, kind="stable")
    sizes = lens[order]
    a = 0
    while a < len(order):
        b = int(np.searchsorted(sizes, 2 * max(int(sizes[a]), 1)))
        b = min(b, a + max(1, CELLS // (2 * max(int(sizes[a]), 1))))
        yield order[a:b]
        a = b


def _tensor(code: np.ndarray, start: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as turns x segments, and lengths, of picked segments."""
    lens = (start[1:] - start[:-1])[pick]
    codes = np.zeros((int(lens.max()), len(pick)), np.int64)
    for t in range(len(codes)):
        on = t < lens
        codes[t, on] = code[start[:-1][pick[on]] + t]
    return codes, lens


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and their row offsets from 0."""
    start = np.asarray(column.offsets, np.int64)
    return column.values.slice(start[0], start[-1] - start[0]), start - start[0]


def _long_lists(rows: np.ndarray) -> pa.Array:
    flat = rows.reshape(len(rows), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1] if len(flat) else [0], pa.int32()), pa.array(flat.ravel(), pa.int64()))


def _per_segment(kernel: Callable, width: int):
    """A map over segments: kernel(codes, lens, pick, batch) gives `width` numbers a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start = _lists(batch.column("rows"))
            code = np.asarray(rows.field("code"), np.int64)
            out = np.zeros((batch.num_rows, width), np.int64)
            for pick in buckets(start[1:] - start[:-1]):
                codes, lens = _tensor(code, start, pick)
                out[pick] = kernel(codes, lens, pick, batch).reshape(len(pick), width)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), _long_lists(out)], ["conv_id", "chunk", "numbers"])

    return run


def _transfer(codes: np.ndarray, lens: np.ndarray, pick: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Costs of each segment from each state to each state."""
    end = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(pick), 4, 4))
    return backward(codes, lens, end)[0]


def _numbers(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    values, _ = _lists(batch.column(name))
    return np.asarray(values, np.int64).reshape(-1, width)


def _exits(codes: np.ndarray, lens: np.ndarray, pick: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """The state in which each segment is left when it is entered in each state."""
    costs = backward(codes, lens, _numbers(batch, "rest", 4)[pick])
    none = np.zeros(len(pick), bool)
    return np.stack([forward(codes, lens, costs, np.full(len(pick), q), none)[3] for q in range(4)], 1)


def _per_conversation(fold: Callable, width: int):
    """A map over conversations: fold(numbers of its segments, in order) gives `width` numbers a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start = _lists(batch.column("parts"))
            chunk = rows.field("chunk")
            numbers = np.asarray(rows.field("numbers").flatten(), np.int64)
            numbers = numbers.reshape(len(chunk), -1)
            out = np.concatenate([fold(numbers[a:b]) for a, b in zip(start[:-1], start[1:])]) if len(start) > 1 else np.zeros((0, width), np.int64)
            which = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(start)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(which), chunk, _long_lists(out.reshape(-1, width))], ["conv_id", "chunk", "numbers"])

    return run


def _rests(tables: np.ndarray) -> np.ndarray:
    """Costs of what follows each segment, from the cost tables of all; the last column tells the last segment."""
    out = np.zeros((len(tables), 5), np.int64)
    cost = ACCEPTED
    for i in range(len(tables) - 1, -1, -1):
        out[i, :4], out[i, 4] = cost, i == len(tables) - 1
        cost = np.minimum((tables[i].reshape(4, 4) + cost).min(1), FAR)
    return out


def _entries(exits: np.ndarray) -> np.ndarray:
    """The state in which each segment is entered, from where each leads."""
    out, state = np.zeros((len(exits), 1), np.int64), 0
    for i, to in enumerate(exits):
        out[i], state = state, to[state]
    return out


def _placed_segments(segments: DataFrame, conv: str) -> DataFrame:
    """segments with rest (costs of what follows), last and entry. Most conversations are one segment and need no more than constants."""
    fields = f"conv_id {conv}, chunk long, numbers array<long>"
    several = segments.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    parts = materialize(segments.select("conv_id", "chunk", F.transform("rows", lambda r: F.struct(r["code"].alias("code"))).alias("rows")).join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "long-conversations")

    def together(numbers: DataFrame, fold: Callable, width: int) -> DataFrame:
        gathered = numbers.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "numbers"))).alias("parts"))
        return gathered.mapInArrow(_per_conversation(fold, width), fields)

    def beside(left: DataFrame, numbers: DataFrame) -> DataFrame:
        right = numbers.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "numbers")
        return left.join(right, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")), "left").drop("c", "k")

    rests = materialize(together(parts.mapInArrow(_per_segment(_transfer, 16), fields), _rests, 5), "rests")
    known = beside(parts, rests).withColumn("rest", F.slice("numbers", 1, 4)).drop("numbers")
    entries = together(known.mapInArrow(_per_segment(_exits, 4), fields), _entries, 1)
    both = rests.withColumnRenamed("numbers", "r").join(entries.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.col("numbers").alias("e")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    own = F.array(*[F.lit(int(x)) for x in (*ACCEPTED, 1, 0)]).cast("array<long>")
    return beside(segments, both.select("conv_id", "chunk", F.concat("r", "e").alias("numbers"))).withColumn("numbers", F.coalesce("numbers", own))


_EDIT = "tail int, turn long, role string, head string, hash binary, pos long, inserted int, entered int, op string, cost int"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row of each segment: its edit and the rows put in before it; one more (tail) where rows are put in at the end."""
    for batch in batches:
        every, start = _lists(batch.column("rows"))
        known = _numbers(batch, "numbers", 6)
        code = np.asarray(every.field("code"), np.int64)
        size = np.diff(start)
        op, inserted, entered = np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        tails: list[np.ndarray] = []
        for pick in buckets(size):
            codes, lens = _tensor(code, start, pick)
            costs = backward(codes, lens, known[pick, :4])
            o, i, e, _ = forward(codes, lens, costs, known[pick, 5], known[pick, 4] == 1)
            for t in range(len(codes)):
                on = t < lens
                at = start[:-1][pick[on]] + t
                op[at], inserted[at], entered[at] = o[t, on], i[t, on], e[t, on]
            at_end = i[lens, np.arange(len(pick))]
            more = np.flatnonzero((at_end > 0) & (known[pick, 4] == 1))
            tails.append(np.stack([pick[more], at_end[more].astype(np.int64), e[lens[more], more].astype(np.int64)], 1))
        tail = np.concatenate(tails) if tails else np.zeros((0, 3), np.int64)
        conv = batch.column("conv_id").take(pa.array(np.concatenate([np.repeat(np.arange(batch.num_rows), size), tail[:, 0]])))
        n = len(tail)

        def column(name: str, kind: pa.DataType) -> pa.Array:
            return pa.concat_arrays([every.field(name).cast(kind), pa.nulls(n, kind)])

        spent = np.where(op == ord("D"), DELETE, np.where(op == ord("R"), REROLE, 0) + np.where(code // 4 == 3, TRUNCATED, 0))
        letters = pa.array([chr(x) for x in op], pa.string())
        arrays = [
            conv, pa.array(np.repeat([0, 1], [len(code), n]), pa.int32()), column("turn", pa.int64()), column("role", pa.string()), column("head", pa.string()), column("hash", pa.binary()), column("pos", pa.int64()),
            pa.array(np.concatenate([inserted, tail[:, 1]]), pa.int32()), pa.array(np.concatenate([entered, tail[:, 2]]), pa.int32()), pa.concat_arrays([letters, pa.array([""] * n, pa.string())]),
            pa.array(np.concatenate([spent, np.zeros(n, np.int64)]), pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *(f.split()[0] for f in _EDIT.split(", "))])


# ---------------------------------------------------------------- replay

#: Edit, role, text and cost of a row.
Step = tuple[str, str, str, int]

_RECORD = ("tag", "role", "text", "inserted", "entered", "op", "cost")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Step | None]]:
    """(conv_id, edit) in order, and (conv_id, None) before the edits of a conversation. A text comes before the edits of its rows."""
    now: list = []
    text = ""
    for batch in batches:
        for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
            for conv, tag, role, body, inserted, state, op, cost in zip(part.column("conv_id"), *(part.column(c).to_pylist() for c in _RECORD)):
                key = conv.as_py()
                if now != [key]:
                    now = [key]
                    yield conv, None
                if tag == 0:
                    text = body
                    continue
                for _ in range(inserted):
                    yield conv, ("I", ROLES[state], "", INSERT)
                    state = int(ONWARD[state])
                if op:
                    yield conv, (op, ROLES[state] if op == "R" else role, text, cost)


def _batch(convs: tuple, names: str, *columns: tuple) -> pa.RecordBatch:
    ids = pa.array([c.as_py() for c in convs], convs[0].type)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in columns)], ["conv_id", *names.split()])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    step = 0
    for conv, edit in _steps(batches):
        if edit is None:
            step = 0
            continue
        out.append((conv, step, *edit[:3]))
        step += 1
        if len(out) == 1 << 12:
            yield _batch(*_columns(out, "step edit role text"))
            out = []
    if out:
        yield _batch(*_columns(out, "step edit role text"))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    letters: list[str] = []
    conv, cost, kept, sha = None, 0, 0, hashlib.sha256()

    def done() -> tuple:
        return conv, cost, "".join(letters), sha.hexdigest()

    for who, edit in _steps(batches):
        if edit is None:
            if conv is not None:
                out.append(done())
            conv, cost, kept, sha, letters = who, 0, 0, hashlib.sha256(), []
            if len(out) == 1 << 12:
                yield _batch(*_columns(out, "cost audit repaired_sha256"))
                out = []
            continue
        letters.append(edit[0])
        cost += edit[3]
        if edit[0] != "D":
            sha.update(f"{chr(10) if kept else ''}{edit[1]}:{edit[2]}".encode("utf-8", "surrogatepass"))
            kept += 1
    if conv is not None:
        out.append(done())
        yield _batch(*_columns(out, "cost audit repaired_sha256"))


def _columns(rows: list[tuple], names: str) -> tuple:
    ids, *rest = zip(*rows)
    return ids, names, *rest


def _replayed(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Texts and edits of each conversation in one order; a worker streams through them."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    edits = _placed_segments(segments, conv).mapInArrow(_edits, f"conv_id {conv}, {_EDIT}").select("*", F.lit(1).alias("tag"), F.lit(None).cast("string").alias("text"))
    empty = {"tail": "0", "pos": "CAST(NULL AS LONG)", "inserted": "0", "entered": "0", "op": "''", "cost": "0", "tag": "0"}
    texts = _keyed(rows).select("conv_id", "turn", "role", "head", "hash", "text", *[F.expr(x).alias(c) for c, x in empty.items()])
    return edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "tail", *_ORDER, "tag", "pos")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, step, edit, role, text: the edits of every conversation in order; a repaired conversation is its rows that are not D.

    rows has conv_id (any type), turn (whole numbers), role and text; other columns play no part. A conversation's rows go by
    turn (nulls first), then role, then text (its first 64 characters, then its MD5). A null role or text is one space. Null conv_ids are
    one conversation. K keeps a row, R makes it the user's or the assistant's, whichever fits, D deletes it, I puts in an empty one.
    Blank rows and rows whose role and text were seen earlier are always deleted. No rows, no result.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    segments = materialize(_segments(rows), "segments")
    return _replayed(rows, segments).mapInArrow(_repaired, f"conv_id {conv}, step long, edit string, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired_sha256; see repair."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    segments = materialize(_segments(rows), "segments")
    done = _replayed(rows, segments).mapInArrow(_audited, f"conv_id {conv}, cost long, audit string, repaired_sha256 string")
    return _together([_counts(segments), done])


_DIGEST = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _together(tables: list[DataFrame]) -> DataFrame:
    """Rows of several tables with one row a conversation; what none of them tells is zero or empty."""
    whole = [t.select("conv_id", *[F.col(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in _DIGEST.items()]) for t in tables]
    every = whole[0]
    for t in whole[1:]:
        every = every.unionByName(t)
    zero = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), zero.get(c, F.lit(0).cast("long"))).alias(c) for c in _DIGEST])


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """audit of the damaged rows, with a row for every original conv_id: zeros, no audit and the empty text's hash where no row is left."""
    return _together([audit(damage(conversations)), conversations.select("conv_id").distinct()])
