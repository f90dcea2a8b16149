"""Operator 12: repair of the structure of conversations by dynamic programming.

The turns of a conversation must give role initials that fit ``(s?(ua)+)?``. A turn is kept (K, costs 0), given the
role user or assistant (R, 3) or deleted (D, 4, the only edit of blank and duplicate turns), and empty turns of user or
assistant are inserted anywhere (I, 3); a truncated turn that is not deleted adds 3. The cheapest edits are found by a
backward pass of costs to go over (turn, state of the grammar), and a forward walk that takes the ASCII-least edit among
those that keep to the costs; of each letter at most one edit fits a state, so the walk is the least of all cheapest
ones. The repaired turns are rebuilt in order and hashed.

Plan: turns are brought into one order of (conversation, turn) by ranges, so a conversation of any size spreads over
tasks, and cut into pieces of at most ``PIECE`` turns. A piece becomes one row with a letter for each of its turns, and
by itself gives its costs from each state at its start to each at its end. These matrices of 4 x 4 are carried backward
over the pieces of a conversation, each piece then walks from each of the four states, and the walks' ends are carried
forward. Only the hash, which needs a conversation's texts in order, sees it in one task, where turns stream past and
none is held. Duplicates are found by a group-wise first place.

Defined cases: null roles and texts count as one space; null turns come first; of turns that are equal in number, role
and then digest of the text decide; rows with a null conversation are one conversation; texts of any length are read
whole; roles are told by their first character, an empty role has none and can't be kept; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import discard, in_python, saved

#: Turns of a piece.
PIECE = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_NEVER = 1 << 50
#: Grammar: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; where a user or assistant turn leads.
_NEXT = (2, 2, 3, 2)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_AT_END = (0, 6, 3, 0)
#: Letters of turns: the initial in lower case is sound, in upper case truncated; one that must go is x, any other role o.
_GONE = "x"


def crc_of_turn() -> Column:
    return F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by a hash of the place: of 20 values 0 drops the turn, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's."""
    fault = F.pmod(crc_of_turn(), F.lit(20))
    rows = turns.select("conv_id", "turn", fault.alias("fault"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def costs_before(letter: str, after: tuple[int, ...] | list[int]) -> list[int]:
    """Costs to go from each state before a turn, of those after it."""
    own, late = letter.lower(), TRUNCATED * letter.isupper()
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if own != _GONE:
            best = min(best, REROLE + late + after[_NEXT[state]])
            if (state, own) in _KEEP:
                best = min(best, late + after[_KEEP[state, own]])
        out.append(best)
    return with_inserts(out)


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first: two at most, as a third would lead back."""
    once = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return [min(c, INSERT + once[_NEXT[s]]) for s, c in enumerate(once)]


def costs_along(letters: str, end: tuple[int, ...] | list[int]) -> list[list[int]]:
    """Costs to go before each of the turns, and after the last."""
    out = [list(end)]
    for letter in reversed(letters):
        out.append(costs_before(letter, out[-1]))
    return out[::-1]


def matrix(letters: str) -> list[int]:
    """Costs from each state before the turns to each after them, row by row."""
    columns = [costs_along(letters, [0 if s == t else _NEVER for s in range(4)])[0] for t in range(4)]
    return [min(columns[t][s], _NEVER) for s in range(4) for t in range(4)]


def walk(letters: str, end: tuple[int, ...] | list[int], state: int, last: bool) -> tuple[str, int]:
    """(edits, state after them) of the least walk among the cheapest; at the ``last`` piece what is missing is inserted."""
    costs, out = costs_along(letters, end), []
    for i, letter in enumerate(letters):
        own, late = letter.lower(), TRUNCATED * letter.isupper()
        while True:
            left, after = costs[i][state], costs[i + 1]
            if DELETE + after[state] == left:
                out.append("D")
            elif INSERT + costs[i][_NEXT[state]] == left:
                out.append("I")
                state = _NEXT[state]
                continue
            elif own != _GONE and (state, own) in _KEEP and late + after[_KEEP[state, own]] == left:
                out.append("K")
                state = _KEEP[state, own]
            else:
                out.append("R")
                state = _NEXT[state]
            break
    while last and state in (1, 2):
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


def _letters(turns: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text, initial, fault): ``at`` rises in the order of turns over all conversations; saved."""
    digest = F.md5(F.col("text").cast("binary"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = saved(rows.withColumn("digest", digest).withColumn("salt", F.rand(7)))  # equal rows may lie in any order, and in several ranges
    order = ("conv_id", "turn", "role", "digest", "salt")
    ordered = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    discard(rows)
    firsts = ordered.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at"), F.count("*").alias("n")).where("n > 1")
    known = F.struct(F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), "role", "digest")
    later = ordered.withColumn("known", known).join(firsts.select(known.alias("known"), F.col("at").alias("first")), "known", "left")
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = F.when(end == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    return later.select("conv_id", "at", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _pieces(letters: DataFrame) -> DataFrame:
    """(conv_id, piece, letters, initials): one row for at most ``PIECE`` turns, in order."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    rows = letters.select("conv_id", F.shiftright("at", PIECE.bit_length() - 1).alias("piece"), F.struct("at", letter.alias("letter"), known.alias("known")).alias("one"))
    grouped = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    of = lambda field: F.array_join(F.transform("turns", lambda x: x[field]), "")
    return grouped.select("conv_id", "piece", F.col("turns")[0]["at"].alias("at"), of("letter").alias("letters"), of("known").alias("initials"))


def _carried(pieces: DataFrame) -> DataFrame:
    """Pieces with their edits: costs are carried backward over a conversation's pieces, then states forward."""
    same = pieces.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, end = object(), None
        for batch in batches:
            ends, lasts, costs = [], [], []
            for c, m in zip(batch["conv_id"], batch["matrix"]):
                c = None if pd.isna(c) else c
                last = c != conv
                conv, end = c, list(_AT_END) if last else end
                ends.append(end)
                lasts.append(last)
                end = [min(int(m[4 * s + t]) + end[t] for t in range(4)) for s in range(4)]
                costs.append(end[0])
            yield batch[same].assign(end=ends, last=lasts, cost=costs)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(matrix=[matrix(x) for x in batch["letters"]])

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            walks = [[walk(x, [int(c) for c in e], s, last) for s in range(4)] for x, e, last in zip(batch["letters"], batch["end"], batch["last"])]
            yield batch.drop(columns="end").assign(audits=[[a for a, _ in w] for w in walks], states=[[s for _, s in w] for w in walks])

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, former = object(), 0, ""
        for batch in batches:
            starts, audits, befores, costs = [], [], [], []
            for c, a, s, i, cost in zip(batch["conv_id"], batch["audits"], batch["states"], batch["initials"], batch["cost"]):
                c = None if pd.isna(c) else c
                first = c != conv
                if first:
                    conv, state, former = c, 0, ""
                starts.append(state)
                audits.append(a[state])
                befores.append(former)
                costs.append(cost if first else 0)
                state, former = int(s[state]), i[-1]
            yield batch[["conv_id", "piece", "at"]].assign(start=starts, audit=audits, illegal=[_illegal(b + i) for b, i in zip(befores, batch["initials"])], cost=costs)

    known = in_python(pieces, measured, f"{schema}, matrix array<long>")
    back = in_python(known.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")), backward, f"{schema}, end array<long>, last boolean, cost long")
    walks = in_python(back, walked, f"{schema}, last boolean, cost long, audits array<string>, states array<int>")
    return in_python(walks.sortWithinPartitions("conv_id", "piece"), forward, "conv_id long, piece long, at long, start int, audit string, illegal long, cost long")


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def _rebuilt(texts: DataFrame, edits: DataFrame, what: str) -> DataFrame:
    """Rows of the repaired conversations in order: (conv_id, audit, repaired_sha256) or, for ``turns``, (conv_id, place, role, text, edit).

    Edits of a piece come before its turns, so a task holds the edits of a piece and one turn; for the hash a
    conversation's edits are gathered as well, as they are its result.
    """
    one = edits.select("conv_id", "at", F.lit(0).alias("kind"), "start", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    turn = texts.select("conv_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("audit"), "role", "text")
    rows = one.unionByName(turn).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")

    def turns_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(conversation, None, None, edits) at the edits of a piece, (conversation, role, text, edit) at each repaired turn."""
        conv, left, state = None, iter(""), 0

        def inserted(edit: str) -> Iterator[tuple]:
            nonlocal state
            role = "assistant" if state == 2 else "user"
            state = _NEXT[state]
            yield conv, role, "", edit

        for batch in batches:
            for c, kind, start, audit, role, text in zip(batch["conv_id"], batch["kind"], batch["start"], batch["audit"], batch["role"], batch["text"]):
                if kind == 0:
                    for edit in left:  # what is inserted after the last turn of the piece before
                        yield from inserted(edit)
                    conv, left, state = None if pd.isna(c) else int(c), iter(audit), int(start)
                    yield conv, None, None, audit
                    continue
                for edit in left:
                    if edit == "I":
                        yield from inserted(edit)
                        continue
                    if edit == "K":
                        state = _KEEP[state, role[0]]
                        yield conv, role, text, edit
                    elif edit == "R":
                        role, state = ("assistant", 3) if state == 2 else ("user", 2)
                        yield conv, role, text, edit
                    break
        for edit in left:
            yield from inserted(edit)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, begun, out = None, False, []
        for conv, role, text, edit in turns_of(batches):
            if not begun or conv != now[0]:
                if begun:
                    out.append((now[0], "".join(now[1]), now[2].hexdigest()))
                now, begun = [conv, [], hashlib.sha256(), True], True
            if role is None:
                now[1].append(edit)
            else:
                now[2].update(f"{'' if now[3] else chr(10)}{role}:{text}".encode("utf-8", "replace"))
                now[3] = False
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv_id", "audit", "repaired_sha256"]).astype({"conv_id": "Int64"})
                out = []
        if begun:
            out.append((now[0], "".join(now[1]), now[2].hexdigest()))
        yield pd.DataFrame(out, columns=["conv_id", "audit", "repaired_sha256"]).astype({"conv_id": "Int64"})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place, now = [], 0, object()
        for conv, role, text, edit in turns_of(batches):
            place, now = (place if conv == now else 0), conv
            if role is not None:
                out.append((conv, place, role, text, edit))
                place += 1
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit"]).astype({"conv_id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text", "edit"]).astype({"conv_id": "Int64"})

    if what == "turns":
        return in_python(rows, listed, "conv_id long, place long, role string, text string, edit string")
    return in_python(rows, hashed, "conv_id long, audit string, repaired_sha256 string")


def _columns(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations, places counted from 0."""
    letters = saved(_letters(_columns(turns)))
    return _rebuilt(letters, saved(_carried(_pieces(letters))), "turns")


def repairs(turns: DataFrame) -> DataFrame:
    """What was wrong with every conversation and how it is repaired, one row each."""
    letters = saved(_letters(_columns(turns)))
    edits = saved(_carried(_pieces(letters)))
    null_safe = lambda df: df.withColumn("no_id", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    by_turn = letters.groupBy("conv_id", "turn").agg(*(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    counts = by_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    costs = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    hashes = _rebuilt(letters, edits, "hashes")
    joined = null_safe(counts).join(null_safe(costs), ["no_id", "conv_id"]).join(null_safe(hashes), ["no_id", "conv_id"])
    return joined.withColumn("conv_id", F.when(~F.col("no_id"), F.col("conv_id"))).drop("no_id")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """``repairs`` of the conversations after ``damaged``, with a row for every one of ``turns``, left or not."""
    found = repairs(damaged(turns)).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = every.join(found.drop("conv_id"), "key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
