"""Conversation structure repair by depth-first branch-and-bound.

The turns of a conversation must read ``(s?(ua)+)?`` by the initials of their roles.  Every turn is
kept (0), given the role user or assistant (2) or deleted (3); turns without text and turns seen
before must be deleted; empty turns of user or assistant may be inserted anywhere (2); a turn that
stays though it breaks off costs 1 more.  Wanted is the cheapest list of edits and, among the
cheapest, the one whose initials (D, I, K, R) come first in ASCII order.

``search`` explores (turn, state of the grammar) from an explicit stack, letters in ASCII order.
A branch ends where its cost and the lower bound of the suffix exceed the incumbent's cost, where
they equal it and its letters are already greater, or where the table of its node holds a prefix
that is no worse.  The lower bound charges every suffix with what no repair avoids: 3 for a turn
that must go, 1 for one that breaks off, 2 for a foreign role, and 1 for every two neighbours that
may not meet (an edit touches two pairs and costs 2 or more, an insertion one).  The search ends
when the stack is empty, which proves the incumbent optimal.

Work is dealt out by turns, not by conversations: turns are sorted by range, blocks of 256
neighbouring turns are searched on their own for every state in which they may be entered and left,
and a conversation's blocks are then put together in order, four prefixes at a time.  Equal turns
of a conversation are merged to one row with a count before anything is shuffled, and whether a
turn was seen before is one aggregation by its digest.  The list of edits of a conversation is one
string, and a digest of its repaired text is read in order; both are streamed.

Defined cases: null role and text are empty (``damage`` makes them one space); turns order by turn
(nulls first), role, text; a role without characters has no initial and is never kept; roles are
judged by their first character alone; repeated rows are duplicates of the first; a null conv_id is
a conversation; a conversation without rows is not in the result (the query adds those that lost
all of theirs); empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import WHITE, small_text_batches, stash

#: Turns of one block; a block is searched in one piece.
BLOCK_BITS = 8
#: Edits of one block: at most three letters for a turn, and a few at the end.
EDIT_BITS = BLOCK_BITS + 3

#: The grammar: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
#: The one letter of u and a that may come next.
OPEN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REACH = {START: {0, 1, 2, 3}, SYSTEM: {1, 2, 3}, USER: {2, 3}, ASSISTANT: {2, 3}}
ENDS = frozenset({START, ASSISTANT})
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
RETYPE, DELETE, INSERT, CUT = 2, 3, 2, 1
NO_LIMIT = 1 << 62


class Item(NamedTuple):
    """A turn that may stay: initial (o for a foreign role), whether it breaks off, and how many
    turns that must go follow it."""

    letter: str
    cut: int
    gone_after: int


def parse(codes: str, copies: list[int]) -> tuple[int, list[Item]]:
    """(turns that must go before the first item, items); x must go, capitals break off, and of
    equal turns all but the first must go."""
    lead, items = 0, []
    for code, n in zip(codes, copies):
        gone = n if code == "x" else n - 1
        if code != "x":
            items.append(Item(code.lower(), int(code.isupper()), gone))
        elif items:
            items[-1] = items[-1]._replace(gone_after=items[-1].gone_after + gone)
        else:
            lead += gone
    return lead, items


def lower_bounds(items: list[Item], goals: frozenset[int]) -> list[int]:
    """What the turns from i on cost at least, whatever the state in which i is reached."""
    low = [0] * (len(items) + 1)
    after = None
    for i in range(len(items) - 1, -1, -1):
        item = items[i]
        charge = item.cut + DELETE * item.gone_after + (RETYPE if item.letter == "o" else 0)
        if item.letter != "o":
            if i == len(items) - 1:
                charge += AFTER[item.letter] not in goals
            elif after != "o":
                charge += item.letter + after not in LEGAL
        low[i] = low[i + 1] + charge
        after = item.letter
    return low


def greedy(items: list[Item], lead: int, start: int, goals: frozenset[int]) -> tuple[int, str]:
    """The first incumbent: keep what fits, retype the rest, insert at the end."""
    cost, letters, state = DELETE * lead, ["D" * lead], start
    for item in items:
        fits = STEP.get((state, item.letter))
        letters.append(("R" if fits is None else "K") + "D" * item.gone_after)
        cost += (RETYPE if fits is None else 0) + item.cut + DELETE * item.gone_after
        state = STEP[state, OPEN[state]] if fits is None else fits
    for _ in range(2):
        if state in goals:
            return cost, "".join(letters)
        cost, state = cost + INSERT, STEP[state, OPEN[state]]
        letters.append("I")
    return (cost, "".join(letters)) if state in goals else (NO_LIMIT, "")


def search(codes: str, copies: list[int], start: int = START, goals: frozenset[int] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the best repair from ``start`` to one of ``goals``; None if there is none."""
    lead, items = parse(codes, copies)
    low, end = lower_bounds(items, goals), len(items)
    best = greedy(items, lead, start, goals)
    tables: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, DELETE * lead, "D" * lead)]
    while stack:
        i, state, cost, audit = stack.pop()
        if not goals & REACH[state]:
            continue
        if i == end:
            bound = cost + (0 if state in goals else INSERT)
        else:
            letter = items[i].letter
            bound = cost + low[i] + (letter != "o" and (state, letter) not in STEP)
        if bound > best[0] or (bound == best[0] and audit > best[1][: len(audit)]):
            continue
        known = tables.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        tables[i, state] = (cost, audit)
        if i == end and state in goals:
            best = min(best, (cost, audit))
            continue
        grown = STEP[state, OPEN[state]]
        if i < end:  # pushed in falling order, so that D is taken up first
            item = items[i]
            gone, extra = "D" * item.gone_after, DELETE * item.gone_after
            stack.append((i + 1, grown, cost + RETYPE + item.cut + extra, audit + "R" + gone))
            fits = STEP.get((state, item.letter))
            if fits is not None:
                stack.append((i + 1, fits, cost + item.cut + extra, audit + "K" + gone))
        stack.append((i, grown, cost + INSERT, audit + "I"))
        if i < end:
            stack.append((i + 1, state, cost + DELETE + extra, audit + "D" + gone))
    return None if best[0] == NO_LIMIT else best


def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every way through a block: entries and exits that its place in the conversation allows."""
    for batch in batches:
        ways, rims, illegal = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("codes", "initials", "copies", "is_first", "is_last")]
        for codes, initials, copies, first, last in zip(*columns):
            found = []
            for a in (START,) if first else STATES:
                for goals in (ENDS,) if last else [frozenset({b}) for b in STATES]:
                    best = search(codes, copies, a, goals)
                    if best is not None:
                        found.append({"a": a, "b": ASSISTANT if last else min(goals), "cost": best[0], "audit": best[1]})
            ways.append(found)
            rims.append(initials[:1] + initials[-1:])
            pairs = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
            illegal.append(pairs + sum(copies) - len(copies))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("block"),
                pa.array(ways, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
                pa.array(rims, pa.string()),
                pa.array(illegal, pa.int64()),
            ],
            names=["conv_id", "block", "ways", "rim", "illegal"],
        )


WAYS = "conv_id long, block long, ways array<struct<a:int,b:int,cost:long,audit:string>>, rim string, illegal long"
JOINED = "conv_id long, block long, state int, piece string, cost long, audit string, illegal long"


def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one repair per conversation: a row per block (state, piece) and one
    (cost, audit, illegal) for the whole, which has no block."""
    names = [f.split()[0] for f in JOINED.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()])))

    def closed(conv, front, trail, illegal):
        best = min(v for k, v in front.items() if k in ENDS)
        state = min(k for k, v in front.items() if k in ENDS and v == best)
        for block, via in reversed(trail):
            state, piece = via[state]
            yield (conv, block, state, piece, None, None, None)
        yield (conv, None, None, None, *best, illegal)

    def rows():
        conv, front, trail, illegal, edge = None, None, [], 0, ""
        for batch in batches:
            for r in batch.to_pylist():
                if front is None or r["conv_id"] != conv:
                    if front is not None:
                        yield from closed(conv, front, trail, illegal)
                    conv, front, trail, illegal, edge = r["conv_id"], {START: (0, "")}, [], 0, ""
                ahead, via = {}, {}
                for w in r["ways"]:
                    if w["a"] in front:
                        cost, audit = front[w["a"]]
                        found = (cost + w["cost"], audit + w["audit"])
                        if w["b"] not in ahead or found < ahead[w["b"]]:
                            ahead[w["b"]], via[w["b"]] = found, (w["a"], w["audit"])
                front = ahead
                trail.append((r["block"], via))
                illegal += r["illegal"] + bool(edge and edge + r["rim"][0] not in LEGAL)
                edge = r["rim"][-1]
        if front is not None:
            yield from closed(conv, front, trail, illegal)

    held = []
    for row in rows():
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


EDITS = "conv_id long, at long, rid long, new_role string, edit string"


def apply_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of a block to the turns that are in the repaired conversation."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("conv_id", "at", "rid", "new_role", "edit")}
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "block", "codes", "copies", "rids", "state", "piece")]
        for conv, block, codes, copies, rids, state, piece in zip(*columns):
            i, left, at = 0, copies[0], block << EDIT_BITS
            for edit in piece:
                letter = OPEN[state] if edit in "IR" else codes[i].lower() if edit == "K" else None
                if letter is not None:
                    out["conv_id"].append(conv)
                    out["at"].append(at)
                    out["rid"].append(None if edit == "I" else rids[i])
                    out["new_role"].append(None if edit == "K" else ROLES[letter])
                    out["edit"].append(edit)
                    state, at = STEP[state, letter], at + 1
                if edit != "I":
                    left -= 1
                    if left == 0 and i + 1 < len(codes):
                        i += 1
                        left = copies[i]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(out["conv_id"], pa.int64()),
                pa.array(out["at"], pa.int64()),
                pa.array(out["rid"], pa.int64()),
                pa.array(out["new_role"], pa.string()),
                pa.array(out["edit"], pa.string()),
            ],
            names=list(out),
        )


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32(conv_id:turn) mod 20; nulls are one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("hit"))
        .where("hit <> 0")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("hit") == 1, "")
            .when(F.col("hit") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.array_repeat(F.lit(True), F.when(F.col("hit") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def judged_turns(rows: DataFrame) -> DataFrame:
    """Distinct turns with their number of copies, the fault of the first copy, and the initial."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = stash(turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    # Where a text was first said: by digest, so that no text is shuffled for it.
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    told = turns.withColumn("digest", digest)
    first = told.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")
    )
    told = told.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    last = F.right(F.rtrim("text", F.lit(WHITE.decode())), F.lit(1))
    fault = (
        F.when(last == "", "blank")
        .when(F.struct(F.col("turn").isNotNull(), "turn") != F.col("first"), "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    initial = F.left("role", F.lit(1))
    return told.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "copies",
        fault.alias("fault"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )


def numbered_turns(rows: DataFrame) -> DataFrame:
    """``judged_turns`` in order: ``rid`` rises along (conv_id, turn, role, text)."""
    order = ["conv_id", "turn", "role", "text"]
    placed = stash(judged_turns(rows)).repartitionByRange(*order).sortWithinPartitions(*order)
    return stash(placed.withColumn("rid", F.monotonically_increasing_id()))


def code() -> Column:
    """One letter for a turn, as ``parse`` reads it."""
    gone = F.col("fault").isin("blank", "duplicate")
    return (
        F.when(gone, "x")
        .when(F.col("fault") == "truncated", F.upper("initial"))
        .otherwise(F.col("initial"))
    )


def blocks_of(turns: DataFrame) -> DataFrame:
    """Neighbouring turns of a conversation, at most 2**BLOCK_BITS, as one row."""
    block = F.shiftright("rid", BLOCK_BITS)
    rims = turns.groupBy(F.col("conv_id").alias("c")).agg(F.min(block).alias("low"), F.max(block).alias("high"))
    made = turns.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("rid", code().alias("code"), "initial", "copies"))).alias("t")
    )
    return made.join(rims, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id",
        "block",
        F.array_join("t.code", "").alias("codes"),
        F.array_join("t.initial", "").alias("initials"),
        F.col("t.copies").alias("copies"),
        F.col("t.rid").alias("rids"),
        (F.col("block") == F.col("low")).alias("is_first"),
        (F.col("block") == F.col("high")).alias("is_last"),
    )


class Repaired(NamedTuple):
    """report: a row per conversation; turns: the repaired turns (conv_id, at, role, text, edit), in
    the order of ``at``."""

    report: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame) -> Repaired:
    small_text_batches(rows.sparkSession)
    turns = numbered_turns(rows)
    blocks = stash(blocks_of(turns))
    ways = blocks.select("conv_id", "block", "codes", "initials", "copies", "is_first", "is_last").mapInArrow(search_blocks, WAYS)
    joined = stash(ways.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(join_blocks, JOINED))

    pieces = joined.where("block IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "state", "piece")
    placed = blocks.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    edits = placed.select("conv_id", "block", "codes", "copies", "rids", "state", "piece").mapInArrow(apply_edits, EDITS)
    edits = stash(edits)
    kept = edits.where("rid IS NOT NULL").join(turns.select("rid", "role", "text"), "rid")
    repaired = kept.select("conv_id", "at", F.coalesce("new_role", "role").alias("role"), "text", "edit").unionByName(
        edits.where("rid IS NULL").select("conv_id", "at", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    )

    def rows_of(fault: str, copies: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("fault") == fault, copies)), F.lit(0)).alias(fault)

    n, extra = F.col("copies"), F.col("copies") - 1
    wide = F.col("turn").cast("decimal(20,0)")
    spread = (F.max(wide) - F.min(wide) + 1 - F.countDistinct("turn")).cast("decimal(22,0)")
    most = F.lit((1 << 63) - 1)
    counts = turns.groupBy(F.col("conv_id").alias("c")).agg(
        F.when(spread > most, most).otherwise(F.coalesce(spread, F.lit(0))).cast("long").alias("gaps"),
        rows_of("blank", n),
        # Of equal turns that are not blank all but the first are duplicates.
        F.coalesce(F.sum(F.when(F.col("fault") == "duplicate", n).when(F.col("fault").eqNullSafe("blank"), 0).otherwise(extra)), F.lit(0)).alias("duplicate"),
        rows_of("truncated", F.lit(1)),
    )
    whole = joined.where("block IS NULL").select("conv_id", "illegal", "cost", "audit")
    report = whole.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return Repaired(report, repaired)


def digest_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined ``line`` of each conversation, from rows in order."""

    def batch_of(done):
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())],
            names=["conv_id", "repaired_sha256"],
        )

    conv, digest = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if digest is None or c != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        if done:
            yield batch_of(done)
    if digest is not None:
        yield batch_of([(conv, digest.hexdigest())])


def repair_report(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """A row for every conversation of ``rows``: the repair of what ``damaged`` holds of it."""
    report, turns = repair_conversations(damaged)
    lines = turns.select("conv_id", "at", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = (
        lines.repartition("conv_id")
        .sortWithinPartitions("conv_id", "at")
        .select("conv_id", "line")
        .mapInArrow(digest_lines, "conv_id long, repaired_sha256 string")
    )
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    made = report.withColumnRenamed("conv_id", "c")
    digests = digests.withColumnRenamed("conv_id", "d")
    whole = every.join(made, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(
        digests, F.col("conv_id").eqNullSafe(F.col("d")), "left"
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
