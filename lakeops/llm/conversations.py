"""Cheapest repair of conversations, by a Viterbi search cut into chunks.

Rows of a conversation are kept, given another role, or deleted, and rows may be inserted, so that the
roles read: perhaps a system row, then user and assistant in turn. A row's step maps the vector of costs
still to come, one cost for each of four states, to the vector before it. Only differences within a vector
matter, and few steps bring different vectors to the same differences.

So rows in order are cut into chunks. Each chunk walks back from a speculative vector (as if nothing came
after it) and hands its first vector to the chunk before. Fix-up passes walk again where the vector that
arrives differs by more than a constant from the one that was used, and stop early at the row where old
and new agree. A pass joins twice as many neighbouring chunks in one walk as the pass before, so even rows
that never bring vectors together take a logarithm of passes. With the vectors settled, the least cheapest
edits are read off forwards; the state in which that enters a chunk is settled in the same way.

Texts stay out of all this: rows are known by their role, the start of the text and 128 bits of hash. Texts
move once, at the end, to be hashed in repaired order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.shared import written
from lakeops.llm.words import bounded_batches

#: Rows of a chunk.
CHUNK = 8192
SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be put in at a state: a user row, or after one an assistant row.
_ADDS = (USER, USER, ASSISTANT, USER)
_KEEPS = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
Vector = tuple[int, int, int, int]


# --- steps of the search -------------------------------------------------------------------------------


def _with_inserts(v: list[int]) -> Vector:
    """Costs to come if rows may be put in first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def _plain(v: Vector) -> Vector:
    least = min(v)
    return v[0] - least, v[1] - least, v[2] - least, v[3] - least


_FAR = 10**6
#: Costs to come at the end of a conversation: accepted are no row at all, and an assistant row last.
FINAL = _plain(_with_inserts([0, _FAR, _FAR, 0]))


def packed_vector(v: Vector) -> int:
    return v[0] | v[1] << 15 | v[2] << 30 | v[3] << 45


def vector_of(x: int) -> Vector:
    return x & 0x7FFF, x >> 15 & 0x7FFF, x >> 30 & 0x7FFF, x >> 45 & 0x7FFF


class Steps:
    """Steps of the search for each symbol (initial of the role, or ``A`` to ``Z`` for a truncated row: its initial in
    upper case; ``x`` and ``X`` for other roles). There are few vectors, so each step is computed once."""

    def __init__(self):
        self.before: dict[tuple[str, Vector], Vector] = {}
        self.chosen: dict[tuple[str, Vector, int], tuple[str, str, str, int, int]] = {}

    @staticmethod
    def _options(symbol: str, after: Vector, state: int):
        """Deletion, keeping, another role: letter, cost with what follows, next state."""
        more = TRUNCATED if symbol.isupper() else 0
        yield "D", DELETE + after[state], state
        kept = _KEEPS.get(symbol.lower(), (None,) * 4)[state]
        if kept is not None:
            yield "K", more + after[kept], kept
        yield "R", REROLE + more + after[_ADDS[state]], _ADDS[state]

    def _costs(self, symbol: str, after: Vector) -> Vector:
        return _with_inserts([min(c for _, c, _ in self._options(symbol, after, s)) for s in range(4)])

    def back(self, symbol: str, after: Vector) -> Vector:
        found = self.before.get((symbol, after))
        if found is None:
            found = self.before[symbol, after] = _plain(self._costs(symbol, after))
        return found

    def choose(self, symbol: str, after: Vector, state: int) -> tuple[str, str, str, int, int]:
        """Letters, initials put in before the row, what becomes of it (``k``, its new initial, or nothing), next state
        and cost; of all cheapest ways the one with the least letters."""
        key = symbol, after, state
        if key not in self.chosen:
            costs, letters, put, cost = self._costs(symbol, after), "", "", 0
            while True:
                options = sorted([*self._options(symbol, after, state), ("I", INSERT + costs[_ADDS[state]], _ADDS[state])])
                letter, total, to = next(o for o in options if o[1] == costs[state])
                letters += letter
                cost += total - (costs if letter == "I" else after)[to]
                if letter == "I":
                    put, state = put + ROLES[to][0], to
                    continue
                row = "" if letter == "D" else "k" if letter == "K" else ROLES[to][0]
                self.chosen[key] = letters, put, row, to, cost
                break
        return self.chosen[key]


def end_of(state: int) -> tuple[str, str, int]:
    """Letters, initials put in, and cost at the end of a conversation."""
    put = {START: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}[state]
    return "I" * len(put), put, INSERT * len(put)


def walk_back(steps: Steps, symbols: str, after: Vector) -> list[Vector]:
    """The vector before the rows, then the one after each row, first to last."""
    out = [after]
    for s in reversed(symbols):
        out.append(steps.back(s, out[-1]))
    return out[::-1]


def again_back(steps: Steps, symbols: str, used: Vector, after: Vector, first: Vector) -> Vector:
    """The vector before the rows from another vector after them; ``first`` came from ``used``. Stops where they agree."""
    for s in reversed(symbols):
        if used == after:
            return first
        used, after = steps.back(s, used), steps.back(s, after)
    return after


def walk_on(steps: Steps, symbols: str, after: Vector, state: int) -> int:
    """The state after the rows."""
    vectors = walk_back(steps, symbols, after)
    for s, v in zip(symbols, vectors[1:]):
        state = steps.choose(s, v, state)[3]
    return state


# --- rows ----------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, n``: rows after the agreed damage, ``n`` times each. What happens to a row follows
    from the CRC-32 of its conversation and turn, modulo 20: 0 drops it, 1 empties its text, 2 takes ``.!?`` out of it,
    3 repeats it, 4 makes it the user's. Null texts and roles count as one blank, as do null parts of that name."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    harm = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    words, own = F.coalesce(F.col(text), blank), F.coalesce(F.col(role), blank)
    return conversations.where(harm != 0).select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.when(harm == 4, "user").otherwise(own).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
        F.when(harm == 3, 2).otherwise(1).cast("long").alias("n"))


def _named(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows by role and digest of their text; also what orders rows of one turn."""
    return rows.select(
        "conv_id", "turn", "role", F.substring("text", 1, 32).alias("begins"), F.xxhash64("text").alias("h1"),
        F.xxhash64(F.lit(7), F.col("text")).alias("h2"), *more)


_NAME = ["role", "begins", "h1", "h2"]
_SORT = ["conv_id", "turn", *_NAME]  # ascending puts nulls first


def _chunker(size: int):
    """Chunks of rows in order. A marker goes before the row that is the first of its role and text."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, marked = TaskContext.get().partitionId(), 0, False
        for batch in batches:
            mark = np.asarray(batch.column("mark"))
            if not len(mark):
                continue
            first = np.concatenate([[marked], mark[:-1]])[~mark]
            marked = bool(mark[-1])
            rows = batch.filter(pa.array(~mark)).drop_columns(["mark"]).append_column("first", pa.array(first))
            for at in range(0, rows.num_rows, size):
                piece = rows.slice(at, size)
                n = piece.num_rows
                conv, turn, initial = (piece.column(c) for c in ("conv_id", "turn", "initial"))
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in piece.columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number]), conv.slice(0, 1), conv.slice(n - 1), turn.slice(n - 1), initial.slice(n - 1),
                     pa.array([conv[0] == conv[n - 1]], pa.bool_()), *lists],
                    ["part", "number", "first_conv", "last_conv", "last_turn", "last_initial", "alone", *(f"{c}s" for c in piece.schema.names)])
                number += 1

    return chunks


def _symbols(initial: list[str], blank: list[bool], truncated: list[bool], first: list[bool]) -> list[str]:
    """One symbol per row; none for rows that must be deleted."""
    return ["" if b or not f else i.upper() if t else i for i, b, t, f in zip(initial, blank, truncated, first)]


# --- what chunks hand on -------------------------------------------------------------------------------


def _settle(state: DataFrame, through: DataFrame, ahead: int, walk: Callable[[dict, int], int]) -> DataFrame:
    """``b, edge``: what each chunk hands to its neighbour, settled for chunks that hand on what they get.

    ``state``: ``b, used, edge`` of all chunks that hand on something; ``through``: chunks ``b, ...`` that
    take over from ``b + ahead``. ``walk(row, arriving)`` gives a chunk's edge anew.
    """
    passes = 0
    while True:
        arriving = state.select((F.col("b") - ahead).alias("b"), F.col("edge").alias("arriving"))
        looked = through.join(state, "b").join(arriving, "b").withColumn("stretch", F.shiftright("b", passes))
        unsettled = looked.where("used <> arriving").select("stretch").distinct()
        if unsettled.isEmpty():
            return state.select("b", "edge")
        rerun = looked.join(unsettled, "stretch", "left_semi")
        columns = rerun.columns

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, edge = None, 0
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    arriving = edge if at == row["b"] + ahead else row["arriving"]
                    edge, at = row["edge"] if arriving == row["used"] else walk(row, arriving), row["b"]
                    out.append((at, arriving, edge))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["b", "used", "edge"])

        order = F.col("b").desc() if ahead > 0 else F.col("b").asc()
        new = rerun.select(*columns).repartition("stretch").sortWithinPartitions(order).mapInArrow(again, "b long, used long, edge long")
        new = written(new, "edges")
        state = written(state.join(new, "b", "left_anti").unionByName(new), "edges")
        passes += 1


def _segments(convs: list) -> list[tuple[int, int]]:
    cuts = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
    return list(zip(cuts[:-1], cuts[1:]))


def _first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its symbols if it is one conversation, its vector from a speculative one, and whether that is sure."""
    steps = Steps()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            symbols = _symbols(row["initials"], row["blanks"], row["truncateds"], row["firsts"])
            low, high = _segments(row["conv_ids"])[0]
            v = walk_back(steps, "".join(symbols[low:high]), FINAL)[0]
            out.append((row["b"], packed_vector(FINAL), packed_vector(v), "".join(symbols) if row["through"] else None))
        if out:
            b, used, edge, symbols = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b), pa.array(used), pa.array(edge), pa.array(symbols, pa.string())], ["b", "used", "edge", "symbols"])


def _first_exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: the state in which its last conversation leaves it, as if that began here."""
    steps = Steps()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            symbols = _symbols(row["initials"], row["blanks"], row["truncateds"], row["firsts"])
            low, high = _segments(row["conv_ids"])[-1]
            out.append((row["b"], START, walk_on(steps, "".join(symbols[low:high]), vector_of(row["right"]), START)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["b", "used", "edge"])


_LEGAL = {"su", "ua", "au"}
_SUMMARY = ["conv_id", "b", "blank", "duplicate", "truncated", "illegal", "least_turn", "most_turn", "turns", "cost", "audit"]
_EDITS = ["turn", *_NAME, "put", "row"]


def _tracer(schema: pa.Schema):
    """Rows of two kinds: a summary per conversation of a chunk, and an edit for every row that stays or has rows put in
    before it; rows put in at the end have no name."""
    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            for row in batch.to_pylist():
                convs, turns, initials, faulty, copies = row["conv_ids"], row["turns"], row["initials"], row["blanks"], row["ns"]
                symbols = _symbols(initials, faulty, row["truncateds"], row["firsts"])
                out: dict[str, list] = {name: [] for name in schema.names}

                def add(**cells):
                    for name in schema.names:
                        out[name].append(cells.get(name))

                parts = _segments(convs)
                for low, high in parts:
                    starts, ends = low > 0 or not row["cont_left"], high < len(convs) or not row["cont_right"]
                    vectors = iter(walk_back(steps, "".join(symbols[low:high]), FINAL if ends else vector_of(row["right"]))[1:])
                    state = START if starts else row["entry"]
                    before = None if starts else row["prev_initial"]
                    turn = None if starts else row["prev_turn"]
                    blank = duplicate = truncated = illegal = distinct = cost = 0
                    audit, seen = [], [t for t in turns[low:high] if t is not None]
                    for i in range(low, high):
                        n, x = copies[i], initials[i]
                        illegal += n - 1 + (before is not None and before + x not in _LEGAL)
                        before = x
                        distinct += turns[i] is not None and turns[i] != turn
                        turn = turns[i]
                        if faulty[i]:
                            blank += n
                        else:
                            duplicate += n - row["firsts"][i]
                            truncated += row["firsts"][i] and row["truncateds"][i]
                        if not symbols[i]:
                            audit.append("D" * n)
                            cost += DELETE * n
                            continue
                        letters, put, kept, state, price = steps.choose(symbols[i], next(vectors), state)
                        audit.append(letters + "D" * (n - 1))
                        cost += price + DELETE * (n - 1)
                        if put or kept:
                            add(conv_id=convs[i], turn=turns[i], put=put, row=kept, **{c: row[f"{c}s"][i] for c in _NAME})
                    if ends:
                        letters, put, price = end_of(state)
                        audit.append(letters)
                        cost += price
                        if put:
                            add(conv_id=convs[low], put=put, row="end")
                    add(conv_id=convs[low], b=row["b"], blank=blank, duplicate=duplicate, truncated=truncated, illegal=illegal,
                        least_turn=min(seen, default=None), most_turn=max(seen, default=None), turns=distinct, cost=cost, audit="".join(audit))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return trace


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows; an edit comes right before its row."""
    nothing = object()
    at, digest, waiting, wrote = nothing, None, None, False
    kind = None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

    def say(role: str, text: str):
        nonlocal wrote
        digest.update((("\n" if wrote else "") + role + ":" + text).encode())
        wrote = True

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        edit = ~np.asarray(batch.column("row").is_null())
        # Rows that no edit precedes are gone.
        wanted = edit | np.concatenate([[waiting is not None], edit[:-1]]) if len(edit) else edit
        for conv, role, row, put, text in zip(*(batch.filter(pa.array(wanted)).column(c).to_pylist() for c in ("conv_id", "role", "row", "put", "text"))):
            if row is not None:
                if conv != at or at is nothing:
                    if at is not nothing:
                        yield done()
                    at, digest, waiting, wrote = conv, hashlib.sha256(), None, False
                for x in put:
                    say({"u": "user", "a": "assistant"}[x], "")
                waiting = row if row != "end" else None
            elif waiting is not None:
                if waiting:
                    say({"k": role, "u": "user", "a": "assistant"}[waiting], text)
                waiting = None
    if at is not nothing:
        yield done()


def repair(
    conversations: DataFrame, damage: bool = True, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK,
) -> DataFrame:
    """Per conversation: ``gaps`` in its turns, rows by their first fault (``blank``, ``duplicate``, ``truncated``),
    ``illegal`` neighbours, the ``cost`` of its cheapest repair, that repair's letters (``audit``: Keep, Rerole, Delete,
    Insert; the least string of those that cost least) and the SHA-256 of the repaired rows.

    With ``damage`` rows are first changed as ``damaged`` says. Rows of one turn are ordered by role, the first 32
    characters of the text and a hash of it; null turns come first and count for no gap. Equal rows are duplicates of
    the first. A null conversation is one like any other. A conversation without rows has zeros and empty strings.
    Other columns do not matter.

    A conversation of any length is spread over tasks, except for its SHA-256: a task reads the rows that stay in order,
    one Arrow batch at a time.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    given = conversations.select(F.col(conv).alias("conv_id"))
    blank = F.lit(" ")
    rows = damaged(conversations, conv, turn, role, text) if damage else conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), F.lit(1).cast("long").alias("n"))
    kind = given.schema["conv_id"].dataType.simpleString()

    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    initial = F.substring("role", 1, 1)
    narrow = _named(
        rows, F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"), "n")
    # Equal rows of a turn are folded before they are shuffled, and so are the first turns of equal texts.
    same = ["conv_id", "turn", *_NAME, "initial", "blank", "truncated"]
    folded = narrow.groupBy(*same).agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marks = narrow.where(~F.col("blank")).groupBy("conv_id", *_NAME).agg(F.min(place).alias("x")).select(
        "conv_id", F.col("x.turn").alias("turn"), *_NAME, F.lit("x").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"),
        F.lit(0).cast("long").alias("n"), F.lit(True).alias("mark"))
    ordered = folded.withColumn("mark", F.lit(False)).unionByName(marks)
    ordered = ordered.repartitionByRange(*_SORT).sortWithinPartitions(*_SORT, F.col("mark").desc())
    lists = f"conv_ids array<{kind}>, turns array<long>, roles array<string>, beginss array<string>, h1s array<long>, h2s array<long>, " \
        "initials array<string>, blanks array<boolean>, truncateds array<boolean>, ns array<long>, firsts array<boolean>"
    chunks = written(ordered.mapInArrow(
        _chunker(chunk), f"part int, number long, first_conv {kind}, last_conv {kind}, last_turn long, last_initial string, alone boolean, {lists}"), "chunks")

    # Chunks are numbered through; one row per partition adds up.
    totals = chunks.groupBy("part").agg(F.count("*").alias("c"))
    base = totals.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("base"))
    ends = written(chunks.join(base, "part").select(
        "part", "number", (F.col("base") + F.col("number")).alias("b"), "first_conv", "last_conv", "last_turn", "last_initial", "alone"), "ends")
    left = ends.select((F.col("b") + 1).alias("b"), F.struct("last_conv", "last_turn", "last_initial").alias("l"))
    right = ends.select((F.col("b") - 1).alias("b"), F.struct("first_conv").alias("r"))
    held = ends.join(left, "b", "left").join(right, "b", "left").select(
        "part", "number", "b", "alone",
        (F.col("l").isNotNull() & F.col("l.last_conv").eqNullSafe(F.col("first_conv"))).alias("cont_left"),
        (F.col("r").isNotNull() & F.col("r.first_conv").eqNullSafe(F.col("last_conv"))).alias("cont_right"),
        F.col("l.last_turn").alias("prev_turn"), F.col("l.last_initial").alias("prev_initial"))
    held = written(held.withColumn("through", F.col("alone") & F.col("cont_left") & F.col("cont_right")), "held")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # chunks are rows of some size
    cells = ["conv_ids", "initials", "blanks", "truncateds", "firsts"]
    chunk_of = chunks.join(held, ["part", "number"])
    handed = written(chunk_of.where("cont_left").select("b", "through", *cells).mapInArrow(
        _first_edges, "b long, used long, edge long, symbols string"), "edges")
    through = handed.where("symbols IS NOT NULL").select("b", "symbols")
    vectors = _settle(handed.select("b", "used", "edge"), through, 1, lambda row, arriving: packed_vector(
        again_back(Steps(), row["symbols"], vector_of(row["used"]), vector_of(arriving), vector_of(row["edge"]))))
    after = vectors.select((F.col("b") - 1).alias("b"), F.col("edge").alias("right"))
    held = written(held.join(after, "b", "left").withColumn("right", F.coalesce("right", F.lit(packed_vector(FINAL)))), "held")

    chunk_of = chunks.join(held, ["part", "number"])
    exits = written(chunk_of.where("cont_right").select("b", "right", *cells).mapInArrow(_first_exits, "b long, used long, edge long"), "edges")
    through = through.join(held.select("b", "right"), "b")
    states = _settle(exits, through, -1, lambda row, arriving: walk_on(Steps(), row["symbols"], vector_of(row["right"]), arriving))
    entries = states.select((F.col("b") + 1).alias("b"), F.col("edge").alias("entry"))

    fields = f"conv_id {kind}, turn long, role string, begins string, h1 long, h2 long, put string, row string, b long, blank long, duplicate long, " \
        "truncated long, illegal long, least_turn long, most_turn long, turns long, cost long, audit string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(fields))
    traced = written(chunks.join(held, ["part", "number"]).join(entries, "b", "left").drop(
        "part", "number", "first_conv", "last_conv", "last_turn", "last_initial", "alone").mapInArrow(_tracer(schema), fields), "traced")
    bounded_batches(spark)

    # Each text row follows its edit, if it has one; an end goes last.
    edits = traced.where("row IS NOT NULL").select("conv_id", (F.col("row") == "end").alias("end"), *_EDITS, F.lit(None).cast("string").alias("text"))
    texts = _named(rows, F.col("text")).select(
        "conv_id", F.lit(False).alias("end"), "turn", *_NAME, F.lit(None).cast("string").alias("put"), F.lit(None).cast("string").alias("row"), "text")
    stream = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "end", "turn", *_NAME, F.col("row").isNull())
    hashed = stream.select("conv_id", "role", "row", "put", "text").mapInArrow(_hasher, f"conv_id {kind}, repaired_sha256 string")

    pieces = traced.where("row IS NULL").select(*_SUMMARY).unionByName(hashed, allowMissingColumns=True).unionByName(
        given.distinct(), allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    total = [F.coalesce(F.sum(c), zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = pieces.groupBy("conv_id").agg(
        F.coalesce(F.max("most_turn") - F.min("least_turn") + 1 - F.sum("turns"), zero).alias("gaps"), *total,
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("b", "audit")))), lambda x: x["audit"]), "").alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
