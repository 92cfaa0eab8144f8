"""Conversation repair as a lightest derivation.

A conversation should read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn. Rows are kept, given another role, deleted, or empty ones
are inserted, each at a price; the cheapest edits that lead to such a sequence
are looked for, and of equally cheap ones those whose initials come first.

Items of the deduction are prefixes: *so many rows are settled and the roles
written so far stand in this state of the pattern*. A row and a prefix give
longer prefixes (keep, rerole, delete); a prefix alone gives one with an
inserted turn. Each rule adds its price to the cost and a letter to the audit,
so it never gives something lighter than its antecedents: cost, then rows
settled, then audit. Items leave an agenda in that order (Knuth's
generalisation of shortest paths to hypergraphs), and the first time an item
leaves it, its cost and audit are final.

Conversations are ordered by ranges of (conversation, turn), so one that holds
a third of all rows is a third of the tasks. They are cut into spans of at most
``SPAN`` rows. For each span the agenda gives the lightest derivation from
every state it may be entered in to every state it may be left in; neighbouring
spans are then joined by the rule (span, span) -> span. Cost and audit stay
comparable under joining, as equally dear derivations of one span never are
prefixes of each other (the longer one would have paid for insertions). A
conversation meets as a whole only as the value it is in the end.

Cases: rows go by turn (null first), then role, then a hash of the text;
repeated rows follow each other; a null conversation id is one conversation;
null roles and texts are one space each, thus a role to be replaced and a blank
text; empty texts are blank; conversations of blank rows are emptied at the
price of deleting these; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import bounded_broadcast
from .common import bounded_batches, cut_lineage

#: rows of a conversation that one agenda takes, and bytes of their texts
SPAN, SPAN_BYTES = 256, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: states: nothing written, behind s, behind u, behind a
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ACCEPTED = (0, 3)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (the four columns) with reproducible faults, by the checksum of
    ``conv:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its sentence
    ends, 3 is there twice, 4 gets the role user. Nulls (in the checksum's
    text, roles and texts) are one space."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % 20
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    return rows.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(filled(role)).alias(role), new.alias(text),
                       F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


@lru_cache(maxsize=20_000)
def lightest(rows: str, enter: int) -> dict[int, tuple[int, str]]:
    """For each state that ``rows`` can end in, cost and audit of the lightest
    derivation that begins in ``enter``. A row is a letter: s, u, a or o (any
    other role), a capital one if truncated, x if it must go."""
    agenda = [(0, 0, "", enter)]
    final: set[tuple[int, int]] = set()
    goals = {}
    while agenda:
        cost, done, audit, state = heapq.heappop(agenda)
        if (done, state) in final:
            continue
        final.add((done, state))
        to = {letter: t for (s, letter), t in STEP.items() if s == state}
        deduced = [(INSERT, done, "I", to[x]) for x in "ua" if x in to]
        if done == len(rows):
            goals[state] = (cost, audit)
        else:
            row = rows[done]
            deduced.append((DELETE, done + 1, "D", state))
            if row != "x":
                more = TRUNCATED * row.isupper()
                deduced += [(REROLE + more, done + 1, "R", to[x]) for x in "ua" if x in to]
                if row.lower() in to:
                    deduced.append((KEEP + more, done + 1, "K", to[row.lower()]))
        for price, n, letter, t in deduced:
            if (n, t) not in final:
                heapq.heappush(agenda, (cost + price, n, audit + letter, t))
    return goals


def joined(spans: list[list[str]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its spans' derivations (texts
    ``enter leave cost audit``), joined one after the other."""
    best = {0: (0, "")}
    for span in spans:
        longer: dict[int, tuple[int, str]] = {}
        for derived in span:
            enter, leave, cost, audit = derived.split(" ")
            if int(enter) in best:
                c, a = best[int(enter)]
                whole = (c + int(cost), a + audit)
                longer[int(leave)] = min(longer.get(int(leave), whole), whole)
        best = longer
    return min(best[q] for q in ACCEPTED if q in best)


def applied(audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired rows. Which role an edit writes follows from the state."""
    out, state, at = [], 0, 0
    for edit in audit:
        if edit != "D":
            letter = roles[at][:1] if edit == "K" else "a" if state == 2 else "u"
            state = STEP[state, letter]
            role = roles[at] if edit == "K" else "assistant" if letter == "a" else "user"
            out.append((role, "" if edit == "I" else texts[at]))
        at += edit != "I"
    return out


def _spans(ordered: DataFrame, conv: T.DataType) -> DataFrame:
    """Spans of rows (``_conv``, ``role``, ``text``, ``_letter``) in order:
    their place, derivations, roles and texts."""
    names = ["_conv", "_at", "_initials", "_derived", "_roles", "_texts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        held, size, known = [], 0, False  # known: the rows held begin their conversation

        def span() -> pa.RecordBatch:
            nonlocal place
            letters = "".join(r[3] for r in held)
            derived = [f"{q} {t} {c} {a}" for q in ((0,) if known else range(4)) for t, (c, a) in lightest(letters, q).items()]
            initials = "".join(r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in held)
            place += 1
            row = [held[0][0], place, initials, derived, [r[1] for r in held], [r[2] for r in held]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string())]
            for row in zip(*(b.column(c).to_pylist() for c in range(4))):
                if held and (row[0] != held[0][0] or len(held) == SPAN or size > SPAN_BYTES):
                    yield span()
                    known = row[0] != held[0][0]
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield span()

    return ordered.mapInArrow(work, T.StructType([
        T.StructField("_conv", conv), T.StructField("_at", T.LongType()), T.StructField("_initials", T.StringType()),
        *[T.StructField(n, T.ArrayType(T.StringType())) for n in names[3:]]]))


def _whole(spans: DataFrame, conv: T.DataType) -> DataFrame:
    """Per conversation: ``illegal``, ``cost``, ``audit`` and ``repaired``."""
    listed = spans.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_at", "_initials", "_derived", "_roles", "_texts"))).alias("_spans"))
    turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column(1).to_pylist():
                initials = "".join(s["_initials"] for s in own)
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
                cost, audit = joined([s["_derived"] for s in own])
                rows = applied(audit, *([x for s in own for x in s[c]] for c in ("_roles", "_texts")))
                out.append((illegal, cost, audit, [{"role": r, "text": t} for r, t in rows]))
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), turns)))],
                                             names=["_conv", "illegal", "cost", "audit", "repaired"])

    return listed.mapInArrow(work, T.StructType([
        T.StructField("_conv", conv), T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
        T.StructField("repaired", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))]))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation that has rows: its id, ``gaps`` (turn numbers between
    the first and last that no row has), rows that are ``blank``, ``duplicate``
    (role and text seen before) or ``truncated`` (the text doesn't end a
    sentence), each counted by its first fault; ``illegal`` neighbours, the
    repair's ``cost`` and ``audit`` and the ``repaired`` turns."""
    bounded_batches(rows.sparkSession)
    given = cut_lineage(rows.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
        F.monotonically_increasing_id().alias("_n"))).withColumn("_hash", F.sha2("text", 256))
    before = F.struct(F.col("_turn").isNotNull().alias("a"), F.col("_turn").alias("b"), F.col("_n").alias("c"))
    # where several rows say the same, the first of them; most rows are alone
    same = given.groupBy("_conv", "role", "_hash").agg(F.min(before).alias("_first"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    same = bounded_broadcast(same.select(F.col("_conv").alias("_c"), F.col("role").alias("_r"), F.col("_hash").alias("_h"), "_first"))
    found = given.join(same, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_hash") == F.col("_h")), "left")
    later = F.coalesce(F.col("_first") < before, F.lit(False))
    # the last solid character: blanks at the end are trimmed, no pattern is tried at each of them
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(later, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    letter = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(F.col("_fault").isin("blank", "duplicate"), "x").when(F.col("_fault") == "truncated", F.upper(letter)).otherwise(letter)
    marked = cut_lineage(found.withColumn("_fault", fault).select("_conv", "role", "text", letter.alias("_letter"), "_turn", "_hash", "_n", "_fault"))

    names = ("blank", "duplicate", "truncated")
    by_turn = marked.groupBy("_conv", "_turn").agg(*[F.count_if(F.col("_fault") == n).alias(n) for n in names])
    missing = F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")
    counts = by_turn.groupBy("_conv").agg(F.coalesce(missing, F.lit(0)).cast("bigint").alias("gaps"), *[F.sum(n).alias(n) for n in names])
    order = [F.col(c).asc_nulls_first() for c in ("_conv", "_turn", "role", "_hash", "_n")]
    ordered = marked.select("_conv", "role", "text", "_letter", "_turn", "_hash", "_n").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = given.schema["_conv"].dataType
    whole = _whole(_spans(ordered.select("_conv", "role", "text", "_letter"), kind), kind).withColumnRenamed("_conv", "_of")
    return counts.join(whole, F.col("_conv").eqNullSafe(F.col("_of"))).select(
        F.col("_conv").alias(conv), "gaps", *names, "illegal", "cost", "audit", "repaired")


def repaired_text(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
