"""Quotation linking: replies from the passages that messages quote.

Lines that begin with one or more ``>`` are quoted, at as many levels; a line that announces a quote goes with it. The
rest is the message's own text. Quoted lines that follow each other at one level are a passage, however its lines are
broken. Passages and own texts are normalised (lower case, words only) and hashed by shingles of three words; a
shingle of a passage belongs to the latest earlier turn of its conversation whose own text has it. A passage is linked to the
turn that most of its shingles belong to, the later on ties, if these are half of them or more; a passage of two words
is linked to a turn that says just these, one of a single word to none. A message replies to the turn that the most shingles of its linked passages at
the lowest level belong to, the later on ties. Messages that replies connect are a thread, named by its first turn;
a conversation is ordered by thread and, within it, by turn, so a reply comes after what it replies to.

Defined results: null text is empty; a message without quotes, or whose quotes match nothing, replies to none and is a
thread unless it is replied to. Rows of one conversation and turn are one message in linking and each kept; ties in
order go by role and the hash of the text. Null conversations or turns are kept, linked to nothing, and ordered first. An
empty table gives no rows. Very long texts are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..plans.cut import bounded_batches, cut, ranked

#: Words of a shingle, and the share of a passage's shingles that one turn must have.
SHINGLE, SHARE = 3, 0.5
QUOTED = re.compile(r"^\s*((?:>[ \t]?)+)(.*)$")
#: What announces a quote: fixed patterns of mail programs in four languages.
ANNOUNCED = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|-+\s*original message\s*-+|[\w .]+ (?:wrote|said|schrieb|escribió))\s*:?\s*$", re.I)
WORD = re.compile(r"\w+")


def shingle_hashes(lines: list[str]) -> set[int]:
    """The hashes of the shingles of what ``lines`` say together: two words are one, a single word has none."""
    words = WORD.findall(" ".join(lines).lower())
    size = min(SHINGLE, len(words))
    if size < 2:
        return set()
    return {xxhash.xxh3_64_intdigest(" ".join(words[i : i + size])) - (1 << 63) for i in range(len(words) - size + 1)}


class Parsed(NamedTuple):
    """A message's text without quotes, the shingles of it, and level and shingles of each quoted passage in turn."""

    text: str
    own: list[int]
    passages: list[tuple[int, list[int]]]


def parsed(text: str | None) -> Parsed:
    """Own lines on two sides of a quote share no shingle."""
    lines = (text or "").splitlines()
    quoted = [QUOTED.match(line) for line in lines]
    own: list[str] = []
    stretches: list[tuple[int, list[str]]] = []  # level, 0 for own lines, and lines
    for i, (line, m) in enumerate(zip(lines, quoted, strict=True)):
        if not m and any(quoted[i + 1 : i + 3]) and ANNOUNCED.match(line):
            continue
        level = m[1].count(">") if m else 0
        if not m:
            own.append(line.rstrip())
        if not stretches or stretches[-1][0] != level:
            stretches.append((level, []))
        stretches[-1][1].append(m[2] if m else line)
    shingles: set[int] = set()
    for level, some in stretches:
        if not level:
            shingles |= shingle_hashes(some)
    passages = [(level, sorted(shingle_hashes(some))) for level, some in stretches if level and any(map(WORD.search, some))]
    return Parsed(re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), sorted(shingles), passages)


def _threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn and thread of each row of ``replies`` (conv_id, turn, reply_to): a reply's turn is later than what it replies to, so pointers are doubled until they meet the first."""
    now = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        now = cut(now.join(above, ["conv_id", "thread"], "left"))
        ended = now.where("above is not null").isEmpty()
        now = now.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"))
        if ended:
            return now


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted and n_linked (passages), reply_to, thread and position of each row."""
    bounded_batches(messages.sparkSession)
    rows = messages.select("conv_id", "turn", "role", "text")
    passage = StructType([StructField("level", IntegerType()), StructField("number", IntegerType()), StructField("hashes", ArrayType(LongType()))])
    schema = StructType([*rows.schema.fields, StructField("own", ArrayType(LongType())), StructField("quotes", ArrayType(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("number", pa.int32()), ("hashes", pa.list_(pa.int64()))]))
        for batch in batches:
            found = [parsed(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([f.text for f in found], pa.string()),
                    pa.array([f.own for f in found], pa.list_(pa.int64())),
                    pa.array([[{"level": level, "number": i, "hashes": h} for i, (level, h) in enumerate(f.passages)] for f in found], kind),
                ],
                names=schema.names,
            )

    every = cut(rows.mapInArrow(run, schema))
    sure = every.where("conv_id is not null and turn is not null")
    each = sure.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.number", "q.hashes")
    asked = each.select("conv_id", "turn", "level", "number", F.size("hashes").alias("size"), F.explode("hashes").alias("hash")).distinct()
    own = sure.select("conv_id", "turn", F.explode("own").alias("hash")).join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").distinct()
    # a shingle's turns in order, so that each quote of it takes the last before its own: no pairs are made
    blank = [F.lit(None).cast("int").alias(c) for c in ("level", "number", "size")]
    merged = own.select("conv_id", "hash", "turn", *blank).unionAll(asked.select("conv_id", "hash", "turn", "level", "number", "size"))
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)
    matched = merged.withColumn("source", source).where("level is not null and source is not null")
    passages = ["conv_id", "turn", "level", "number", "size"]
    votes = matched.groupBy(*passages, "source").agg(F.count("*").alias("n"))
    best = votes.groupBy(*passages).agg(F.max(F.struct("n", "source")).alias("b")).where(F.col("b.n") >= SHARE * F.col("size"))
    turns = best.groupBy("conv_id", "turn", "level", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("n"), F.count("*").alias("linked"))
    replies = cut(
        turns.groupBy("conv_id", "turn").agg(
            F.max(F.struct((-F.col("level")).alias("l"), "n", "source")).alias("best"),
            F.sum("linked").alias("n_linked"),
        ).select("conv_id", "turn", F.col("best.source").alias("reply_to"), "n_linked")
    )
    known = every.join(replies, ["conv_id", "turn"], "left").join(_threads(replies), ["conv_id", "turn"], "left")
    known = known.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.size("quotes").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
    )
    placed, _ = ranked(known, ["conv_id", "thread", "turn", "role", F.xxhash64("text")], "_rank")
    first = placed.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_rank").alias("_first"))
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("position", F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_conv")
