"""Conversations repaired at least cost, by an auction for shortest paths.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Rows may be kept, given another
role, deleted, and empty ones inserted, each at an integer cost. A node of the lattice is a number of
rows used up and the state of what has been put out; the cheapest repair is a shortest path to its end.

The auction keeps a price for every node and one path. At the path's last node it compares the price
with the cheapest arc (cost plus the price at its head): a price below that is raised to it and the path
is contracted by a node, otherwise the path is extended along that arc. Prices only rise and never
exceed the distance to the end, and on the path they equal it when the end is reached. The edits are
then read off the tight arcs (price = cost + price at the head), at every node the one of the least
letter: one that is not on a shortest path would need a price below the distance at its head, but then
the path would have been extended along it first, and it was found dearer.

Long conversations are cut into blocks of rows. The auction finds each block's costs between the
states at its two ends, those give the prices at the borders, and with them the blocks are traced on
their own. So a conversation of any length is dealt to many tasks. Only two things follow its rows
in order, in streams over sorted rows that hold no text: cutting it into blocks (a byte a row), and
joining its edits with its texts. The edits of a conversation are one value of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import rows as arrow_rows
from encore.session import materialise

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what has been put out: nothing, or its last initial
FINAL = (START, ASSISTANT)
AFTER = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT})  # by s, u, a
FILLED = (USER, USER, ASSISTANT, USER)  # state after a row that gets or is put in with the fitting role
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS, OTHER, CUT_OFF, GONE = "sua", 3, 4, 8  # a row's code: initial, plus CUT_OFF; or GONE
LEGAL = {(0, 1), (1, 2), (2, 1)}
BLOCK = 64  # rows
FAR = 1 << 60  # no way
BLANKS, NOT_BLANK = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
TIE_CHARS = 64


def _arcs(code: int | None, state: int) -> tuple[tuple[int, int, str], ...]:
    """(cost, step to the head, letter) of a node's arcs by letter; no code: all rows are used up."""
    arcs = [(INSERT_COST, FILLED[state] - state, "I")]
    if code is not None:
        arcs.append((DELETE_COST, 4, "D"))
        extra = TRUNCATED_COST if code & CUT_OFF else 0
        if code < GONE:
            arcs.append((REROLE_COST + extra, 4 + FILLED[state] - state, "R"))
            kept = AFTER[code % 4].get(state) if code % 4 < OTHER else None
            if kept is not None:
                arcs.append((KEEP_COST + extra, 4 + kept - state, "K"))
    return tuple(sorted(arcs, key=lambda arc: arc[2]))


ARCS = {code: [_arcs(code, state) for state in range(4)] for code in [*range(GONE + 1), None]}


class Lattice:
    """One block of rows with a cost for leaving it in each state."""

    def __init__(self, codes: bytes, exits: tuple[int, ...], last: bool):
        self.codes, self.exits = codes, exits
        self.end = ARCS[None] if last else ((),) * 4
        self.prices = [0] * (4 * len(codes) + 4)
        # Deleting everything and putting in a pair reaches whatever can be reached.
        self.limit = DELETE_COST * len(codes) + 4 * INSERT_COST + max(e for e in exits if e < FAR)

    def cheapest(self, node: int) -> tuple[int, int, str]:
        """Cost and head of the node's cheapest arc at current prices, the least letter of equals.

        The head is -1 for leaving the block, which comes before all letters.
        """
        prices, layer, state = self.prices, node // 4, node % 4
        least, head, letter = FAR, -1, ""
        if layer < len(self.codes):
            arcs = ARCS[self.codes[layer]][state]
        else:
            arcs, least = self.end[state], self.exits[state]
        for cost, step, name in arcs:
            if cost + prices[node + step] < least:
                least, head, letter = cost + prices[node + step], node + step, name
        return least, head, letter

    def distance(self, state: int) -> int:
        """From a state before the first row; prices of earlier calls are built upon."""
        path = [state]
        while True:
            node = path[-1]
            least, head, _ = self.cheapest(node)
            if self.prices[node] < least:
                self.prices[node] = least
                if len(path) > 1:
                    path.pop()
                elif least > self.limit:
                    return FAR
            elif head < 0:
                return self.prices[state]
            else:
                path.append(head)

    def trace(self, state: int) -> tuple[str, int]:
        """Letters along the tight arcs, and the state the block is left in."""
        self.distance(state)
        node, letters = state, []
        while True:
            _, head, letter = self.cheapest(node)  # on the path this is the tight arc
            if head < 0:
                return "".join(letters), node % 4
            letters.append(letter)
            node = head


ENDING = tuple(0 if state in FINAL else FAR for state in range(4))


@lru_cache(1 << 15)
def solved(codes: bytes) -> tuple[str, int]:
    """Edits and cost of a whole conversation of one block."""
    lattice = Lattice(codes, ENDING, last=True)
    return lattice.trace(START)[0], lattice.prices[START]


def crossings(codes: bytes, last: bool) -> list[int]:
    """Costs from each state before the block to each one after it; of the last block, to the end."""
    if last:
        lattice = Lattice(codes, ENDING, last)
        return [cost for state in range(4) for cost in (lattice.distance(state), FAR, FAR, FAR)]
    found = [FAR] * 16
    for leave in range(4):
        lattice = Lattice(codes, tuple(0 if s == leave else FAR for s in range(4)), last)
        for enter in range(4):
            found[4 * enter + leave] = lattice.distance(enter)
    return found


def damaged(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, weight): damaged rows; weight 0 is dropped, 2 stands there twice.

    The damage follows crc32 of ``conv:turn`` modulo 20, with one space for a null.
    """
    key = F.concat(
        F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    read = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(key) % 20).alias("hit"))
    return read.select(
        "conv", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("weight"))


def _row_order() -> dict[str, Column]:
    """Order of rows within a conversation, besides its turn."""
    return {
        "start": F.substring("text", 1, TIE_CHARS),
        "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
    }


ORDER = ("turn", "role", "start", "digest")


def numbered_faults(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: how many there are, and the code of the first.

    A row is a duplicate unless it is the first of its role and text; that is found from the least
    turn of each, so no task gathers a conversation or a phrase that is said again and again.
    """
    initial = F.array_position(
        F.array(*[F.lit(c) for c in INITIALS]), F.substring("role", 1, 1)).cast("int") - 1
    present = F.col("weight") > 0
    facts = rows.withColumns(_row_order()).select(
        "conv", "turn", *[F.when(present, F.col(name)).alias(name) for name in ORDER[1:]],
        F.when(F.col("role").substr(1, 1).isin(*INITIALS), initial).otherwise(OTHER).alias("initial"),
        F.col("text").rlike(NOT_BLANK).alias("said"),
        F.col("text").rlike(rf"[.!?][{BLANKS}]*\z").alias("ended"), "weight")
    same = materialise(facts.groupBy("conv", "turn", "digest").agg(
        *[F.min(name).alias(name) for name in ("role", "start", "initial", "said", "ended")],
        F.sum("weight").alias("copies")), "turns")
    # Nulls come first among turns, and so do they in the least of the pairs.
    pair = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = materialise(same.filter("copies > 0").groupBy("conv", "digest").agg(
        F.min(pair).alias("first")), "first-said")
    left, right = same.alias("l"), firsts.alias("r")
    joined = left.join(
        right, F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.digest") == F.col("r.digest")), "left")
    return joined.select(
        *[F.col(f"l.{name}").alias(name) for name in ("conv", *ORDER, "initial", "said", "ended", "copies")],
        F.col("r.first.turn").eqNullSafe(F.col("l.turn")).alias("first"))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
BLOCKS = ("block int, last boolean, codes binary, "
          + ", ".join(f"{name} long" for name in COUNTS))


class Conversation:
    """What is known of a conversation while its rows go by."""

    def __init__(self, conv, size: int):
        self.conv, self.codes, self.block, self.size = conv, bytearray(), 0, size
        self.low = self.high = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial, said, ended, copies, first) -> Iterator[tuple]:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        self.illegal += copies - 1 + (self.before is not None and (self.before, initial) not in LEGAL)
        self.before = initial
        if not said:
            self.blank += copies
        else:
            self.duplicate += copies - first
            self.truncated += first and not ended
        gone = copies if not said or not first else copies - 1
        if gone < copies:
            self.codes.append(initial + (0 if ended else CUT_OFF))
        while gone:
            more = min(gone, 1 << 16)
            self.codes += bytes([GONE]) * more
            gone -= more
            yield from self.full()
        yield from self.full()

    def full(self) -> Iterator[tuple]:
        """Blocks that have all their rows; the last one stays open."""
        while len(self.codes) > self.size:
            yield (self.conv, self.block, False, bytes(self.codes[:self.size]), *[None] * len(COUNTS))
            del self.codes[:self.size]
            self.block += 1

    def close(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, self.block, True, bytes(self.codes), gaps, self.blank, self.duplicate,
                self.truncated, self.illegal)


def _batches(found: Iterator[tuple], schema: pa.Schema, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, of 4,096 rows or ``most`` bytes of text each."""
    waiting, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*waiting, strict=True), schema, strict=True)],
            schema=schema)

    for row in found:
        waiting.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(waiting) >= 4096 or size >= most:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()


def blocks_of(facts: DataFrame, size: int) -> DataFrame:
    """(conv, block, last, codes, counts): blocks of up to ``size`` rows, counts with the last one."""
    kind = facts.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, {BLOCKS}"

    def cut(batches):
        types = [None]

        def found():
            now = None
            for batch in batches:
                types[0] = batch.schema.field(0).type
                for conv, *facts in arrow_rows([batch]):
                    if now is None or conv != now.conv:
                        if now is not None:
                            yield now.close()
                        now = Conversation(conv, size)
                    yield from now.add(*facts)
            if now is not None:
                yield now.close()

        yield from _typed(found(), types, [
            ("block", pa.int32()), ("last", pa.bool_()), ("codes", pa.binary()),
            *[(name, pa.int64()) for name in COUNTS]])

    ordered = facts.repartition("conv").sortWithinPartitions("conv", *ORDER)
    return ordered.select("conv", "turn", "initial", "said", "ended", "copies", "first").mapInArrow(
        cut, schema)


def _typed(found: Iterator[tuple], conv_type: list, fields: list) -> Iterator[pa.RecordBatch]:
    """Batches of rows that start with a conversation's id, whose type is known by the first row."""
    first = next(found, None)
    if first is None:
        return

    def all_rows():
        yield first
        yield from found

    yield from _batches(all_rows(), pa.schema([("conv", conv_type[0]), *fields]))


def edits(blocks: DataFrame) -> DataFrame:
    """Add to blocks: ``letters`` by the state before the block, ``leads`` (state after it), ``cost``.

    ``cost`` is that of the conversation, with its first block.
    """
    kind = blocks.schema["conv"].dataType.simpleString()
    whole = F.col("last") & (F.col("block") == 0)
    solution = "letters array<string>, leads array<int>, cost long"
    result = f"conv {kind}, {BLOCKS}, {solution}"

    def extended(batch, letters, leads, cost):
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(COUNTS) + 4], pa.array(letters, pa.list_(pa.string())),
             pa.array(leads, pa.list_(pa.int32())), pa.array(cost, pa.int64())],
            names=[*batch.schema.names[:len(COUNTS) + 4], "letters", "leads", "cost"])

    def short(batches):
        for batch in batches:
            found = [solved(codes) for codes in batch.column("codes").to_pylist()]
            yield extended(batch, [[letters] for letters, _ in found], [[START]] * len(found),
                           [cost for _, cost in found])

    def cross(batches):
        for batch in batches:
            costs = [crossings(codes, last) for codes, last in zip(
                batch.column("codes").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("block"), pa.array(costs, pa.list_(pa.int64()))],
                names=["conv", "block", "costs"])

    def borders(table: pa.Table) -> pa.Table:
        """Prices behind each block, from the last to the first: 16 costs for each block of rows."""
        table = table.sort_by("block")
        price, behind = [0] * 4, []
        for costs in reversed(table.column("costs").to_pylist()):
            behind.append(price)
            price = [min(FAR, *(costs[4 * s + t] + price[t] for t in range(4))) for s in range(4)]
        return pa.table({
            "conv": table.column("conv"), "block": table.column("block"),
            "exits": pa.array(behind[::-1], pa.list_(pa.int64())),
            "cost": pa.array([price[START]] + [None] * (len(behind) - 1), pa.int64())})

    def traced(batches):
        for batch in batches:
            letters, leads = [], []
            for codes, last, exits in zip(*[batch.column(n).to_pylist() for n in ("codes", "last", "exits")],
                                          strict=True):
                lattice = Lattice(codes, ENDING if last else tuple(exits), last)
                ways = [lattice.trace(state) for state in range(4)]
                letters.append([way[0] for way in ways])
                leads.append([way[1] for way in ways])
            yield extended(batch, letters, leads, batch.column("cost").to_pylist())

    # Blocks are small but take long: a number of tasks that is not reduced by their size.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = blocks.filter(~whole)
    costs = long.select("conv", "block", "last", "codes").repartition(tasks, "conv", "block").mapInArrow(
        cross, f"conv {kind}, block int, costs array<long>")
    prices = materialise(costs.groupBy("conv").applyInArrow(
        borders, f"conv {kind}, block int, exits array<long>, cost long"), "borders")
    met = long.alias("l").join(
        prices.alias("r"),
        F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.block") == F.col("r.block"))
    ).select("l.*", "r.exits", "r.cost").repartition(tasks, "conv", "block")
    return blocks.filter(whole).mapInArrow(short, result).unionByName(met.mapInArrow(traced, result))


def _repaired_stream(
    conversations: DataFrame, conv: str, turn: str, role: str, text: str, block: int,
) -> DataFrame:
    """Rows of repaired conversations in order, each conversation followed by a row of its results."""
    rows = damaged(conversations, conv, turn, role, text)
    blocks = materialise(blocks_of(numbered_faults(rows), block), "blocks")
    kind = blocks.schema["conv"].dataType.simpleString()
    pieces = edits(blocks).drop("codes", "last").withColumn("weight", F.lit(0))
    texts = rows.filter("weight > 0").withColumns(_row_order()).withColumn(
        "text", F.when(F.col("text").rlike(NOT_BLANK), F.col("text")))  # blank rows go in any case
    mixed = pieces.unionByName(texts, allowMissingColumns=True)
    ordered = mixed.repartition("conv").sortWithinPartitions(
        "conv", F.col("weight") > 0, "block", *ORDER)
    fields = [("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
              *[(name, pa.int64()) for name in (*COUNTS, "cost")], ("audit", pa.string())]

    def apply(batches):
        types = [None]

        def found():
            for conv, own in _by_conversation(batches, types):
                yield from _repair(conv, own)

        yield from _typed(found(), types, fields)

    return ordered.select(
        "conv", "weight", "role", "text", "letters", "leads", *COUNTS, "cost"
    ).mapInArrow(apply, f"conv {kind}, at long, edit string, role string, text string, "
                 + ", ".join(f"{name} long" for name in (*COUNTS, "cost")) + ", audit string")


def _by_conversation(batches, types) -> Iterator[tuple]:
    """(id, iterator over its rows) of each conversation; the rows must be read before the next."""
    from itertools import groupby

    def all_rows():
        for batch in batches:
            types[0] = batch.schema.field(0).type
            yield from arrow_rows([batch])

    for (_, conv), own in groupby(all_rows(), lambda row: (row[0] is None, row[0])):
        yield conv, own


def _repair(conv, own) -> Iterator[tuple]:
    letters, state, totals, cost = [], START, None, 0
    out, done, at = START, 0, 0
    audit = ""
    for _, weight, role, text, ways, leads, *counts in own:
        if not weight:  # the blocks come before the rows, in their order
            letters.append(ways[state])
            state = leads[state]
            *found, price = counts
            cost = price if price is not None else cost
            totals = found if found[0] is not None else totals
            continue
        audit = audit or "".join(letters)
        for _ in range(weight):
            while audit[at] == "I":
                out = FILLED[out]
                yield (conv, done, "I", ROLE[out], "", *[None] * (len(COUNTS) + 2))
                done, at = done + 1, at + 1
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                out, name = AFTER[INITIALS.index(role[0])][out], role
            else:
                out = FILLED[out]
                name = ROLE[out]
            yield (conv, done, edit, name, text, *[None] * (len(COUNTS) + 2))
            done += 1
    audit = audit or "".join(letters)
    for _ in audit[at:]:
        out = FILLED[out]
        yield (conv, done, "I", ROLE[out], "", *[None] * (len(COUNTS) + 2))
        done += 1
    yield (conv, None, None, None, None, *totals, cost, audit)


def repaired_turns(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", block: int = BLOCK,
) -> DataFrame:
    """The repaired conversations: conversation id, ``at`` (from 0), ``edit`` (K, R or I), role, text."""
    found = _repaired_stream(
        conversations, conv_column, turn_column, role_column, text_column, block)
    return found.filter("at is not null").select(
        F.col("conv").alias(conv_column), "at", "edit", "role", "text")


def repair_report(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
    role_column: str = "role", text_column: str = "text", block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: counts of its faults after damage, the repair's cost and edits, and
    the SHA-256 of the repaired rows (``role:text`` by newlines).

    Rows of a conversation go by turn, nulls first; of one turn by role, then by the first 64
    characters of the text, then by a hash of role and text. A null role or text is one space, a null
    id a conversation of its own. Equal rows are told by SHA-256; from the second on they are
    duplicates. A conversation that loses all rows has zeros, no edits and the hash of nothing; an
    empty table gives no rows; other columns are not read. The hash needs a conversation's texts in
    order, so they pass through one task, row by row. ``block`` rows are solved at once.
    """
    found = _repaired_stream(
        conversations, conv_column, turn_column, role_column, text_column, block)
    kind = found.schema["conv"].dataType.simpleString()
    counts = [(name, pa.int64()) for name in (*COUNTS, "cost")]

    def digest(batches):
        types = [None]

        def found():
            for conv, own in _by_conversation(batches, types):
                state = sha256()
                for _, at, _, role, text, *results in own:
                    if at is None:
                        yield conv, *results, state.hexdigest()
                    else:
                        state.update(f"{chr(10) if at else ''}{role}:{text}".encode())

        yield from _typed(found(), types, [*counts, ("audit", pa.string()), ("sha", pa.string())])

    report = found.mapInArrow(digest, f"conv {kind}, " + ", ".join(
        f"{name} long" for name, _ in counts) + ", audit string, sha string")
    return report.select(
        F.col("conv").alias(conv_column), *COUNTS, "cost", "audit", F.col("sha").alias("repaired_sha256"))
