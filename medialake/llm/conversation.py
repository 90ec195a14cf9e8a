"""Repair of conversations: the cheapest edits after which the roles are an optional system turn and then pairs of user and assistant.

The edits are found by Knuth's agenda over weighted deductions. An item (i, state) says that the first i turns are repaired and the roles so far leave the pattern in this
state. Deductions keep, rerole or delete the next turn, or insert one; each adds to (cost, audit), never makes it less, and keeps the order of the values of an item, so
an item that is popped is final, and so is the goal. Two audits of the same cost for the same item never are one the beginning of the other, as an audit says its own cost.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import saved, small_batches

#: Nothing said, a system turn last, a user's last, an assistant's last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Whose turn an insertion or a new role gives, after each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Where a kept turn with this initial leads.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: A turn in one letter: its role's initial (x: none of the three), and its first fault.
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
CODES = "ABCDEFGHIJKLMNOP"
MEANING = {CODES[4 * i + f]: (INITIALS[i], f) for i in range(4) for f in range(4)}
#: Turns whose items are on the agenda at once.
SEGMENT = 512
#: White space, and what ends a turn that isn't cut short.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"


def deductions(code: str | None, state: int) -> Iterator[tuple[int, str, int, int]]:
    """cost, edit, turns taken and next state of each way to go on from an item; code: the next turn, if there is one."""
    yield INSERT, "I", 0, NEXT[state]
    if code is None:
        return
    initial, fault = MEANING[code]
    yield DELETE, "D", 1, state
    if fault in (1, 2):  # blank and repeated turns go
        return
    short = CUT_SHORT if fault == 3 else 0
    if (initial, state) in KEPT:
        yield KEEP + short, "K", 1, KEPT[initial, state]
    yield REROLE + short, "R", 1, NEXT[state]


def agenda(codes: str, entering: list[tuple[int, str, int]], goal: bool) -> list[tuple[int, str, int]]:
    """cost, audit, state of the items behind the last of `codes`, from the items before the first; with goal, only the lightest that the pattern accepts."""
    n, done, left = len(codes), set(), []
    heap = [(cost, audit, 0, state) for cost, audit, state in entering]
    heapq.heapify(heap)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if goal and state in (START, ASSISTANT):
                return [(cost, audit, state)]
            left.append((cost, audit, state))
        for more, edit, taken, to in deductions(codes[i] if i < n else None, state):
            if (i + taken, to) not in done:
                heapq.heappush(heap, (cost + more, audit + edit, i + taken, to))
    return left


def lightest(codes: str, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of the cheapest repair. Long conversations are gone through in segments; what all items at a cut have in common of their audits is set aside there."""
    known, items = [], [(0, "", START)]
    for at in range(0, len(codes), segment):
        part = codes[at : at + segment]
        items = agenda(part, items, at + segment >= len(codes))
        shared = os.path.commonprefix([audit for _, audit, _ in items])
        known.append(shared)
        items = [(cost, audit[len(shared) :], state) for cost, audit, state in items]
    return items[0][0], "".join(known) + items[0][1]


def damaged(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with the faults of the exercise: crc32 of `conv_id:turn`, modulo 20, drops, empties, strips, repeats or gives to the user. Nulls of text columns are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), which.alias("which")).where("which <> 0")
    role = F.when(F.col("which") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("which") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@dataclass
class Repaired:
    """report: a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, place, edit, role, text of what stays or is put in, each conversation in order within one partition."""

    report: DataFrame
    turns: DataFrame


def key_of(conv: str = "conv_id") -> Column:
    """The conversation as text; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


#: The order of turns: equal turns stand by role and text, so rows that tie are equal.
ORDER = ("turn", "role", "digest")


def coded(turns: DataFrame) -> DataFrame:
    """key, codes of each conversation: a letter a turn, in order.

    Turns without their texts are range-partitioned by conversation and order and numbered; a text that was seen earlier is one whose number isn't the least of its conversation,
    role and digest. Letters are joined in segments first. A conversation's codes are one cell, of a byte a turn, as its audit is.
    """
    text = F.col("text")
    bare = F.rtrim(text, F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(*ENDS), 3).otherwise(0)
    initial = F.when(F.startswith(F.col("role"), F.lit("s")), 1).when(F.startswith(F.col("role"), F.lit("u")), 2).when(F.startswith(F.col("role"), F.lit("a")), 3).otherwise(4)
    rows = turns.select(key_of().alias("key"), "turn", "role", F.unhex(F.sha2(text, 256)).alias("digest"), fault.alias("fault"), initial.alias("initial"))
    by = [F.col(c).asc_nulls_first() for c in ("key", *ORDER)]
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by, F.col("salt")).sortWithinPartitions(*by).drop("salt")
    rows = saved(rows.withColumn("rid", F.monotonically_increasing_id()), "turns")
    again = rows.groupBy("key", "role", "digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(again, ["key", "role", "digest"], "left")
    fault = F.when((F.col("fault") != 1) & (F.col("rid") > F.col("first")), 2).otherwise(F.col("fault"))
    letter = F.substring(F.lit(CODES), 4 * (F.col("initial") - 1) + fault + 1, F.lit(1))
    joined = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), "")
    parts = rows.select("key", "rid", F.floor(F.col("rid") / SEGMENT).alias("segment"), letter.alias("letter")).groupBy("key", "segment").agg(joined("rid", "letter").alias("part"))
    return parts.groupBy("key").agg(joined("segment", "part").alias("codes"))


def solved(codes: DataFrame) -> DataFrame:
    """key, blank, duplicate, truncated, illegal, cost, audit of codes(key, codes)."""
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word in batch.column(1).to_pylist():
                said = [MEANING[c] for c in word]
                faults = [sum(f == k for _, f in said) for k in (1, 2, 3)]
                illegal = sum((a, b) not in LEGAL for (a, _), (b, _) in zip(said, said[1:]))
                out.append((*faults, illegal, *lightest(word)))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.string())], names=["key", *counts, "audit"])

    return codes.mapInArrow(solve, StructType([StructField("key", StringType()), *[StructField(c, LongType()) for c in counts], StructField("audit", StringType())]))


def edited(turns: DataFrame, audits: DataFrame, kind) -> DataFrame:
    """turns by their audits(key, conv_id, audit): a conversation's audit comes before its turns in one sorted stream, so a task holds one audit and one batch of turns."""
    names = ("key", "tag", "conv_id", *ORDER, "text", "audit")
    empty = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = audits.select("key", F.lit(0).alias("tag"), "conv_id", empty("turn", turns.schema["turn"].dataType), empty("role", "string"), empty("digest", "binary"), empty("text", "string"), "audit")
    rows = turns.select(key_of().alias("key"), F.lit(1).alias("tag"), "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", empty("audit", "string"))
    stream = heads.unionByName(rows).repartition("key").sortWithinPartitions("key", "tag", *[F.col(c).asc_nulls_first() for c in ORDER])
    schema = StructType([StructField("conv_id", kind), StructField("place", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, conv, place, state = "", 0, None, 0, START
        for batch in batches:
            out = []

            def put_in() -> None:
                nonlocal at, place, state
                while at < len(audit) and audit[at] == "I":
                    state = NEXT[state]
                    out.append((conv, place, "I", "user" if state == USER else "assistant", ""))
                    at, place = at + 1, place + 1

            for tag, of, role, text, told in zip(*(batch.column(names.index(c)).to_pylist() for c in ("tag", "conv_id", "role", "text", "audit"))):
                if tag == 0:
                    audit, at, conv, place, state = told or "", 0, of, 0, START
                else:
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = SYSTEM if role[0] == "s" else NEXT[state]
                    elif edit == "R":
                        state = NEXT[state]
                        role = "user" if state == USER else "assistant"
                    if edit != "D":
                        out.append((conv, place, edit, role, text))
                        place += 1
                put_in()
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:]]], names=[f.name for f in schema.fields])

    return stream.select(*names).mapInArrow(walk, schema)


def repair(original: DataFrame, turns: DataFrame) -> Repaired:
    """Repairs turns(conv_id, turn, role, text), which has no null role or text, for every conversation of original(conv_id).

    A conversation stands by turn, nulls first, then by role and text. Of each turn the first fault counts: blank, seen earlier in role and text, not ended by one of ENDS. Null
    conversations are one. One without turns has no faults, an empty audit and no turns. Other columns are ignored. A conversation's texts go through one task as a stream.
    """
    small_batches(original.sparkSession)
    found = solved(coded(turns))
    spans = turns.groupBy(key_of().alias("key")).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    every = original.groupBy(key_of().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    report = every.join(found, "key", "left").join(spans, "key", "left")
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    report = saved(report.select("key", "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit")), "repairs")
    return Repaired(report.drop("key"), edited(turns, report, original.schema["conv_id"].dataType))


def joined_sha256(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of Repaired.turns: `role:text`, joined by line ends. Hashed as the rows stream by, in their order; only conversations with turns have a row."""
    schema = StructType([turns.schema["conv_id"], StructField("repaired_sha256", StringType())])
    names = turns.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, kind = None, None, None
        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for of, place, role, text in zip(*(batch.column(names.index(c)).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = of, hashlib.sha256()
                digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out])], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.mapInArrow(run, schema)
