"""Cheapest repair of conversations to alternating turns, as a lightest derivation.

A conversation's rows are to spell an optional system turn and then pairs of a user's and
an assistant's turn. The items of the deduction say how far the rows are read and what
turn came last; an item's weight is its cost and its audit, the edits' initials so far.
An edit of the next row, or an inserted turn, derives one item from another by a function
that only adds to cost and audit, so the agenda may finalise the lightest item it holds:
Knuth's generalisation of Dijkstra's method. The goal item ends the work.

Conversations of any length are cut where blocks of ``BLOCK`` rows end, whatever
conversations these belong to. For a piece the derivation gives the lightest way from
each item before it to each after it; a conversation of several pieces is put together
from those, a few numbers a piece. So no task holds more rows than a block, one very long
conversation included.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import prepare, stored
from plumbline.operators.ordering import prefix_sums

#: Rows of a block: what one call of the deduction may span.
BLOCK = 4096
#: Rows of a piece that the agenda works on at once.
PIECE = 256

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: What an undeleted row that ends in the middle of a sentence adds.
TRUNCATED_COST = 1
USER, ASSISTANT = "user", "assistant"

# What the last turn was. At the start and after an assistant a conversation may end.
START, SYSTEM_TURN, USER_TURN, ASSISTANT_TURN = range(4)
ENDS = (START, ASSISTANT_TURN)
#: What a turn with this initial leads to.
NEXT = {
    START: {"s": SYSTEM_TURN, "u": USER_TURN},
    SYSTEM_TURN: {"u": USER_TURN},
    USER_TURN: {"a": ASSISTANT_TURN},
    ASSISTANT_TURN: {"u": USER_TURN},
}
#: The one role that an inserted or changed turn can have after each.
MADE = {START: USER, SYSTEM_TURN: USER, USER_TURN: ASSISTANT, ASSISTANT_TURN: USER}

#: Blank, and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"

# A row for the deduction: initial of its role, must it go, is it cut off.
Row = tuple[str, bool, bool]
Weight = tuple[int, str]


def _edits(state: int, row: Row) -> Iterator[tuple[int, int, str]]:
    """Deductions over one row: the state after it, what it costs, its initial."""
    initial, must_go, cut_off = row
    yield state, COSTS[DELETE], DELETE
    if must_go:
        return
    more = TRUNCATED_COST if cut_off else 0
    if initial in NEXT[state]:
        yield NEXT[state][initial], COSTS[KEEP] + more, KEEP
    yield NEXT[state][MADE[state][0]], COSTS[REROLE] + more, REROLE


def lightest(rows: list[Row], entry: int = START, goals: tuple[int, ...] | None = None):
    """Weights of the items after all ``rows``, by state, starting in ``entry``.

    With ``goals``, the lightest of those states alone, insertions after the last row
    included, as soon as it is finalised; without, every state just after the last row.
    Weights at one place and of equal cost differ before either ends, since equal
    beginnings cost the same and further insertions cost more; so adding to both keeps
    their order, which the agenda relies on.
    """
    # an item: rows read, whether turns may have been inserted since, the last turn
    agenda: list[tuple[int, str, int, bool, int]] = [(0, "", 0, False, entry)]
    done: set[tuple[int, bool, int]] = set()
    found: dict[int, Weight] = {}
    while agenda:
        cost, audit, read, inserted, state = heapq.heappop(agenda)
        if (read, inserted, state) in done:
            continue
        done.add((read, inserted, state))
        if not inserted:
            if read == len(rows) and goals is None:
                found[state] = (cost, audit)
                continue
            heapq.heappush(agenda, (cost, audit, read, True, state))
            continue
        if read == len(rows) and goals is not None and state in goals:
            return {state: (cost, audit)}
        made = NEXT[state][MADE[state][0]]
        heapq.heappush(agenda, (cost + COSTS[INSERT], audit + INSERT, read, True, made))
        if read < len(rows):
            for after, more, initial in _edits(state, rows[read]):
                heapq.heappush(agenda, (cost + more, audit + initial, read + 1, False, after))
    return found


def derive(rows: list[Row], entry: int = START, last: bool = True) -> dict[int, Weight]:
    """As ``lightest``, over pieces of ``PIECE`` rows, put together one after the other.

    With ``last`` the one lightest weight that may end a conversation.
    """
    cuts = range(0, max(len(rows), 1), PIECE)
    weights: dict[int, Weight] = {entry: (0, "")}
    for low in cuts:
        piece = rows[low : low + PIECE]
        goals = ENDS if last and low + PIECE >= len(rows) else None
        better: dict[int, Weight] = {}
        for state, (cost, audit) in weights.items():
            for after, (more, edits) in lightest(piece, state, goals).items():
                weight = (cost + more, audit + edits)
                if after not in better or weight < better[after]:
                    better[after] = weight
        weights = better
    if last:
        state, weight = min(weights.items(), key=lambda item: item[1])
        return {state: weight}
    return weights


def follow(rows: list[Row], audit: str, entry: int = START):
    """What an audit does: per row (roles put before, edit, made role, roles after, cost)."""
    state, place = entry, 0
    before: list[str] = []
    done: list[list] = []
    for edit in audit:
        if edit == INSERT:
            before.append(MADE[state])
            state = NEXT[state][MADE[state][0]]
            continue
        initial, _, cut_off = rows[place]
        role = MADE[state] if edit == REROLE else None
        if edit != DELETE:
            state = NEXT[state][initial if edit == KEEP else role[0]]
        more = TRUNCATED_COST if cut_off and edit != DELETE else 0
        cost = COSTS[edit] + more + COSTS[INSERT] * len(before)
        done.append([before, edit, role, [], cost])
        before, place = [], place + 1
    if before:
        done[-1][3] = before
        done[-1][4] += COSTS[INSERT] * len(before)
    return done


def _to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_PIECES = T.StructType(
    [
        T.StructField("first", T.LongType()),
        T.StructField("chain", T.LongType()),
        T.StructField("entry", T.IntegerType()),
        T.StructField("exit", T.IntegerType()),
        T.StructField("cost", T.LongType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("audit", T.StringType()),
        T.StructField("initials", T.ArrayType(T.StringType())),
        T.StructField("must_go", T.ArrayType(T.BooleanType())),
        T.StructField("cut_off", T.ArrayType(T.BooleanType())),
    ]
)
_EDITS = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("before", T.ArrayType(T.StringType())),
        T.StructField("edit", T.StringType()),
        T.StructField("made_role", T.StringType()),
        T.StructField("after", T.ArrayType(T.StringType())),
        T.StructField("cost", T.LongType()),
    ]
)


def _pieces_of_block(table: pa.Table) -> pa.Table:
    """The ways through the conversations' parts of one block.

    A part that is a whole conversation gives its lightest way. Any other gives the
    lightest from each state it may begin in to each it may end in.
    """
    names = ("place", "conversation", "ends_at", "initial", "must_go", "cut_off")
    rows = sorted(zip(*[table[name].to_pylist() for name in names]))
    made: list[tuple] = []
    low = 0
    while low < len(rows):
        first, conversation, ends_at = rows[low][:3]
        high = low
        while high < len(rows) and rows[high][1] == conversation:
            high += 1
        part = [row[3:] for row in rows[low:high]]
        begins, ends = first == conversation, rows[high - 1][0] == ends_at
        columns = tuple(zip(*part))
        for entry in (START,) if begins else range(4):
            weights = derive(part, entry, last=begins and ends)
            ranked = sorted(weights.items(), key=lambda item: item[1][1])
            for order, (state, (cost, audit)) in enumerate(ranked):
                chain = None if begins and ends else conversation
                made.append((first, chain, entry, state, cost, order, audit, *columns))
        low = high
    schema = _to_arrow(_PIECES)
    return pa.Table.from_arrays(
        [pa.array(list(x), field.type) for x, field in zip(zip(*made), schema)], schema=schema
    )


def _best_chain(table: pa.Table) -> pa.Table:
    """The pieces of one long conversation to use: ``first, entry, exit``.

    Two ways to one state end in different audits before either ends, so which is smaller
    is told by the order of the ways so far and, after the same one, by the order within
    the piece. No audit is looked at.
    """
    names = ("first", "entry", "exit", "cost", "order")
    ways = sorted(zip(*[table[name].to_pylist() for name in names]))
    # state -> (cost, rank among the states), and per piece: exit -> entry
    reached: dict[int, tuple[int, int]] = {START: (0, 0)}
    came: list[tuple[int, dict[int, int]]] = []
    low = 0
    while low < len(ways):
        first = ways[low][0]
        best: dict[int, tuple[int, int, int, int]] = {}
        while low < len(ways) and ways[low][0] == first:
            _, entry, state, more, order = ways[low]
            low += 1
            if entry in reached:
                cost, rank = reached[entry]
                way = (cost + more, rank, order, entry)
                if state not in best or way < best[state]:
                    best[state] = way
        ranks = sorted(best, key=lambda state: best[state][1:3])
        reached = {state: (best[state][0], ranks.index(state)) for state in best}
        came.append((first, {state: way[3] for state, way in best.items()}))
    # turns still to be inserted after the last row
    missing = {START: 0, ASSISTANT_TURN: 0, USER_TURN: 1, SYSTEM_TURN: 2}
    state = min(reached, key=lambda s: (reached[s][0] + missing[s] * COSTS[INSERT], reached[s][1]))
    found = []
    for first, entries in reversed(came):
        found.append((first, entries[state], state))
        state = entries[state]
    firsts, entries, exits = zip(*found)
    return pa.table(
        {
            "first": pa.array(firsts, pa.int64()),
            "entry": pa.array(entries, pa.int32()),
            "exit": pa.array(exits, pa.int32()),
            "last": pa.array([first == came[-1][0] for first in firsts], pa.bool_()),
        }
    )


def _to_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _to_arrow(_EDITS)
    for batch in batches:
        made: list[tuple] = []
        for piece in batch.to_pylist():
            rows = list(zip(piece["initials"], piece["must_go"], piece["cut_off"]))
            audit = piece["audit"]
            if piece["last"] and piece["chain"] is not None:
                audit += INSERT * {USER_TURN: 1, SYSTEM_TURN: 2}.get(piece["exit"], 0)
            for place, edit in enumerate(follow(rows, audit, piece["entry"]), piece["first"]):
                made.append((place, *edit))
        columns = zip(*made) if made else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), field.type) for x, field in zip(columns, schema)], schema=schema
        )


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _is_truncated(text: Column) -> Column:
    return ~text.rlike(rf"(?s)[.!?]{BLANK}*\z")


def find_faults(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every row with its place in the order of all rows and its first fault.

    ``(place, conversation, turn, role, text, fault, cut_off)`` under those names. Rows are
    ordered by conversation, then by turn, missing ones first, then by role and text. The
    ``fault`` is ``blank`` (nothing but blanks), ``duplicate`` (role and text that an
    earlier row of the conversation has), ``truncated`` (the last character but blanks is
    none of ``.!?``) or null. A missing role or text counts as one space, a missing
    conversation is one of its own. The result is written to the shared folder.
    """
    space = F.lit(" ")
    content = turns.select(
        F.col(f"`{conversation}`").alias("conversation"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    )
    order = [
        F.col("conversation").asc_nulls_first(),
        F.col("turn").asc_nulls_first(),
        F.col("role"),
        F.col("text"),
    ]
    placed = stored(prefix_sums(content, order, {"place": F.lit(1).cast("bigint")}, keep=stored))
    # of equal rows of a conversation the first; names hold for texts, by SHA-256
    firsts = placed.groupBy("conversation", "role", F.sha2("text", 256).alias("_digest")).agg(
        F.min("place").alias("place")
    ).select("place", F.lit(True).alias("_is_first"))
    fault = (
        F.when(_is_blank(F.col("text")), "blank")
        .when(F.col("_is_first").isNull(), "duplicate")
        .when(_is_truncated(F.col("text")), "truncated")
    )
    return stored(
        placed.join(firsts, "place", "left")
        .withColumn("fault", fault)
        .withColumn("cut_off", F.coalesce(fault == "truncated", F.lit(False)))
        .drop("_is_first")
    )


def lightest_edits(faults: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(place, before, edit, made_role, after, cost)`` of every row of ``find_faults``.

    ``edit`` is K, R, D as in ``repair``; ``before`` and ``after`` are the roles of the
    turns inserted around it, ``made_role`` the new role of an R.
    """
    # a conversation is known by its first row's place
    spans = faults.groupBy("conversation").agg(
        F.min("place").alias("_first"), F.max("place").alias("_last")
    )
    marks = spans.select(F.col("_first").alias("place"), F.struct("_first", "_last").alias("_span"))
    number = F.floor(F.col("place") / F.lit(block)).cast("bigint")
    rows = faults.select(
        "place",
        F.substring("role", 1, 1).alias("initial"),
        F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must_go"),
        "cut_off",
    ).withColumn("block", number)
    # every block needs the spans that begin in it, and the one that runs on from before
    begun = marks.withColumn("block", number)
    covered = begun.select(
        "_span",
        F.explode(
            F.sequence(F.col("block"), F.floor(F.col("_span._last") / F.lit(block)).cast("bigint"))
        ).alias("block"),
    )
    pieces = stored(
        rows.groupBy("block")
        .cogroup(covered.select("block", "_span._first", "_span._last").groupBy("block"))
        .applyInArrow(_joined_block, _PIECES)
    )
    open_pieces = pieces.where(F.col("chain").isNotNull())
    chains = (
        open_pieces.select("chain", "first", "entry", "exit", "cost", "order")
        .groupBy("chain")
        .applyInArrow(_best_chain, "first bigint, entry int, exit int, last boolean")
    )
    chosen = (
        pieces.where(F.col("chain").isNull())
        .withColumn("last", F.lit(True))
        .unionByName(open_pieces.join(chains, ["first", "entry", "exit"]))
    )
    return chosen.mapInArrow(_to_edits, _EDITS)


def _joined_block(rows: pa.Table, spans: pa.Table) -> pa.Table:
    """Rows of a block with the first and last place of their conversation."""
    schema = _to_arrow(_PIECES)
    if not rows.num_rows:
        return schema.empty_table()
    firsts, lasts = spans["_first"].to_numpy(), spans["_last"].to_numpy()
    order = np.argsort(firsts)
    at = np.searchsorted(firsts[order], rows["place"].to_numpy(), side="right") - 1
    return _pieces_of_block(
        rows.append_column("conversation", pa.array(firsts[order][at])).append_column(
            "ends_at", pa.array(lasts[order][at])
        )
    )


def repair(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Every row with its cheapest edit, and the lines that take its place.

    ``conversation, place, turn, role, text, fault, edit, before, made_role, after, cost,
    lines``. ``edit`` is K (kept), R (role made user or assistant, cost 2) or D (deleted,
    cost 3; blank and duplicate rows have to be). ``before`` and ``after`` hold the roles of
    turns with empty text inserted there (I, cost 2 each); an undeleted truncated row costs
    1 more. ``lines`` are the repaired ``(role, text)`` turns, in order. The repaired turns of a
    conversation begin with at most one turn whose role has the initial s, then turns
    with u and a alternate, up to an a; of the cheapest ways the one whose edits spell the
    smallest word is taken. A role without a character is kept nowhere.

    Nulls and the order of rows are those of ``find_faults``; repeated rows are duplicates.
    Other columns are left out, whatever they are called. No row gives no row. Texts take
    no part in the deduction: it reads initials and two flags of ``block`` rows at most.
    """
    prepare(turns.sparkSession)
    faults = find_faults(turns, conversation, turn, role, text)
    edited = faults.join(lightest_edits(faults, block), "place")

    def empty_turns(roles: str) -> Column:
        return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

    own = F.struct(F.coalesce("made_role", "role").alias("role"), F.col("text").alias("text"))
    kept = F.when(F.col("edit") == DELETE, F.filter(F.array(own), lambda _: F.lit(False))).otherwise(
        F.array(own)
    )
    return edited.withColumn("lines", F.concat(empty_turns("before"), kept, empty_turns("after"))).drop(
        "cut_off"
    )


#: Pairs of initials that may follow one another.
LEGAL_PAIRS = ("su", "ua", "au")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summaries(turns: DataFrame, repaired: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row for every conversation of ``turns``, from its rows in ``repaired``.

    ``conversation, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``: missing numbers between the first and last turn; rows by first
    fault; neighbours whose roles' initials are no legal pair; the edits' cost and their
    initials; the SHA-256 of the repaired turns, ``role:text`` in lines. A conversation that
    has no row in ``repaired`` has zeros, an empty audit and the hash of nothing.

    A conversation's hash depends on its bytes in order, so its lines pass through one
    task; they stream through it, and only the audit is held.
    """
    initial = F.substring("role", 1, 1)
    previous = repaired.select(
        (F.col("place") + 1).alias("place"),
        F.col("conversation").alias("_before"),
        initial.alias("_initial"),
    )
    follows = F.col("_initial").isNotNull() & F.col("conversation").eqNullSafe(F.col("_before"))
    illegal = follows & ~F.concat("_initial", initial).isin(*LEGAL_PAIRS)
    flags = {name: F.col("fault").eqNullSafe(name) for name in ("blank", "duplicate", "truncated")}
    counted = repaired.join(previous, "place", "left").select(
        "conversation",
        "turn",
        "cost",
        *[flag.cast("bigint").alias(name) for name, flag in flags.items()],
        illegal.cast("bigint").alias("illegal"),
    )
    zero = F.lit(0).cast("bigint")
    known = turns.select(
        F.col(f"`{conversation}`").alias("conversation"),
        F.lit(None).cast(turns.schema[turn].dataType).alias("turn"),
        *[zero.alias(name) for name in ("cost", *flags, "illegal")],
    )
    number = F.col("turn").cast("bigint")
    gaps = F.max(number) - F.min(number) + 1 - F.count_distinct(number)
    counts = counted.unionByName(known).groupBy("conversation").agg(
        F.coalesce(gaps, zero).alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")],
    )
    letters = F.concat(
        F.repeat(F.lit(INSERT), F.size("before")), "edit", F.repeat(F.lit(INSERT), F.size("after"))
    )
    line = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    # the counts of a conversation come before its rows
    heads = counts.select(
        "conversation", F.lit(-1).cast("bigint").alias("place"), *_COUNTS,
        F.lit("").alias("audit"), F.lit(None).cast("string").alias("lines"),
    )
    rows = repaired.select(
        "conversation", "place", *[zero.alias(name) for name in _COUNTS], letters.alias("audit"),
        F.when(F.size("lines") > 0, F.array_join(line, "\n")).alias("lines"),
    )
    kind = counts.schema["conversation"].dataType
    schema = T.StructType(
        [T.StructField("conversation", kind)]
        + [T.StructField(name, T.LongType()) for name in _COUNTS]
        + [T.StructField(name, T.StringType()) for name in ("audit", "repaired_sha256")]
    )
    return (
        heads.unionByName(rows)
        .repartition("conversation")
        .sortWithinPartitions("conversation", "place")
        .mapInArrow(_hashed(schema), schema)
        .withColumnRenamed("conversation", conversation)
    )


def _hashed(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _to_arrow(schema)
        head: tuple | None = None
        audit: list[str] = []
        digest, lines = hashlib.sha256(), 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(x), field.type) for x, field in zip(columns, arrow)], schema=arrow
            )

        for batch in batches:
            ended: list[tuple] = []
            columns = [batch[name].to_pylist() for name in ("conversation", *_COUNTS)]
            places, letters, texts = (batch[name] for name in ("place", "audit", "lines"))
            for i, place in enumerate(places.to_pylist()):
                if place < 0:
                    if head is not None:
                        ended.append((*head, "".join(audit), digest.hexdigest()))
                    head = tuple(column[i] for column in columns)
                    audit, digest, lines = [], hashlib.sha256(), 0
                    continue
                audit.append(letters[i].as_py())
                text = texts[i].as_py()
                if text is not None:
                    digest.update((("\n" if lines else "") + text).encode())
                    lines += 1
            yield made(ended)
        if head is not None:
            yield made([(*head, "".join(audit), digest.hexdigest())])

    return run
