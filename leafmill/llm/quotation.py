"""Chat formatting with quotation linking.

A message's lines are parsed for nested quote levels (``> > text``). Runs of lines of one level are
a passage; passages and the unquoted units of every message (its whole body, its paragraphs, lines
and sentences) are normalised (A-Z lower-cased, white space collapsed) and hashed. A hash leads to
the earliest message of its own conversation with that unit, or else to the earliest of all
messages, if that comes before it in (conversation, turn). A passage links to where its whole hash
leads; an excerpt, whose whole hash leads nowhere, to the message that most of its own paragraphs,
lines and sentences lead to, the earliest of equals. A message replies to what its outermost linked
passage quotes, or else to the turn before it. Conversations that quote each other form one thread;
inside it, (conv_id, turn) is an order in which every message follows what it quotes.

Passages meet one row per unit, however often the unit occurs, so common lines cost no more than
rare ones. Conversations come out in parts of at most PART turns, and parts of more than MOST
messages (repeated rows, messages without ids) in slices.

Defined cases: null text is empty, and a message of quotes alone has an empty body; null ids link
to nothing; repeated rows are repeated messages; of several texts with one conversation and turn,
each counts as that message; units of fewer than MIN_WORDS words are not looked up unless they are
a whole body; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.tables import materialize

MIN_WORDS = 4
PART = 64
#: Messages of a part that come out in one row, about.
MOST = 1024
_QUOTE = re.compile(r"(?:[ \t]?>)+[ \t]?")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_ATTRIBUTION = re.compile(r"^(?:On\b.{0,200}|.{1,200}) wrote:\s*$")
PARSED = "conv_id long, turn long, role string, body string, units array<binary>, quotes array<struct<place: int, level: int, whole: boolean, hash: binary>>, n_quotes int"


def _normal(text: str) -> str:
    return " ".join(re.sub("[A-Z]+", lambda m: m[0].lower(), text).split())


def _hash(normal: str) -> bytes:
    return hashlib.blake2b(normal.encode(), digest_size=16).digest()


def _pieces(text: str) -> set[str]:
    """Normalised paragraphs, lines and sentences of MIN_WORDS words or more."""
    pieces = [*re.split(r"\n[ \t]*\n", text), *text.split("\n"), *_SENTENCE.split(text)]
    return {n for p in pieces if (n := _normal(p)).count(" ") + 1 >= MIN_WORDS}


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, int, bool, bytes]], int]:
    """(body without quotes, hashes of its units, (place, level, whole or piece, hash) of quoted
    passages and of their pieces, number of passages)."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        mark = _QUOTE.match(line)
        level = mark[0].count(">") if mark else 0
        if level:
            if last != level:
                if last == 0 and own and _ATTRIBUTION.match(own[-1]):
                    own.pop()
                passages.append((level, []))
            passages[-1][1].append(line[mark.end() :])
        else:
            own.append(line)
        last = level
    body = "\n".join(own).strip("\n") if passages else (text or "")
    whole = _normal(body)
    units = _pieces(body) | ({whole} if whole else set())
    quotes = []
    count = 0
    for place, (level, lines) in enumerate(passages):
        quoted = "\n".join(lines)
        if normal := _normal(quoted):
            count += 1
            quotes.append((place, level, True, _hash(normal)))
            quotes += [(place, level, False, _hash(p)) for p in sorted(_pieces(quoted) - {normal})]
    return body, sorted(_hash(u) for u in units), quotes, count


def _parsed(messages: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            body, units, quotes, count = zip(*map(parse, batch.column("text").to_pylist()), strict=True)
            quotes = [[{"place": p, "level": v, "whole": w, "hash": h} for p, v, w, h in q] for q in quotes]
            kind = pa.list_(pa.struct([("place", pa.int32()), ("level", pa.int32()), ("whole", pa.bool_()), ("hash", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(body, pa.string()), pa.array(units, pa.list_(pa.binary())), pa.array(quotes, kind), pa.array(count, pa.int32())], names=["conv_id", "turn", "role", "body", "units", "quotes", "n_quotes"])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(rows, PARSED)


def link_messages(messages: DataFrame) -> DataFrame:
    """One row per message: at (a key of the row), conv_id, turn, role, body, n_quotes, n_linked, reply_conv, reply_turn, thread_id."""
    parsed = materialize(_parsed(messages).withColumn("at", F.monotonically_increasing_id()), "parsed")
    known = parsed.where("conv_id is not null and turn is not null")
    quotes = known.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").distinct()
    wanted = quotes.select("hash").distinct()
    units = known.select("conv_id", "turn", F.explode("units").alias("hash")).join(wanted, "hash", "left_semi")
    inside = units.groupBy("conv_id", "hash").agg(F.min("turn").alias("turn"))
    inside = materialize(inside, "units")
    first = inside.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    linked = quotes.join(inside.select("conv_id", "hash", F.col("turn").alias("own")), ["conv_id", "hash"], "left").join(first, "hash", "left")
    far = (F.col("first.conv_id") < F.col("conv_id")) | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") < F.col("turn")))
    origin = F.when(F.col("own") < F.col("turn"), F.struct("conv_id", F.col("own").alias("turn"))).when(far, F.col("first"))
    found = linked.select("conv_id", "turn", "level", "place", "whole", origin.alias("origin")).where("origin is not null")
    votes = found.groupBy("conv_id", "turn", "level", "place", "origin").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    passages = votes.groupBy("conv_id", "turn", "level", "place").agg(F.min(F.struct(~F.col("whole"), -F.col("n"), "origin")).alias("best"))
    per = passages.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", "place", F.col("best.origin").alias("origin"))).alias("reply"))
    per = materialize(per.select("conv_id", "turn", "n_linked", F.col("reply.origin.conv_id").alias("quoted_conv"), F.col("reply.origin.turn").alias("quoted_turn")), "replies")
    threads = connected_components(per.where("quoted_conv <> conv_id").select(F.col("conv_id").alias("u"), F.col("quoted_conv").alias("v")).distinct())

    # the turn before: turns of a conversation, in parts, so that a long one is not one group
    turns = known.select("conv_id", "turn").distinct().withColumn("part", F.floor(F.col("turn") / PART))
    within = F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn"))
    ends = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(Window.partitionBy("conv_id").orderBy("part")))
    before = turns.withColumn("before", within).join(ends, ["conv_id", "part"]).select("conv_id", "turn", F.coalesce("before", "end").alias("before"))

    out = parsed.join(per, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    out = out.join(threads.select(F.col("node").alias("conv_id"), F.col("component").alias("thread")), "conv_id", "left")
    quoted = F.col("quoted_turn").isNotNull()
    return out.select(
        "at",
        "conv_id",
        "turn",
        "role",
        "body",
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.when(quoted, F.col("quoted_conv")).when(F.col("before").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.coalesce("quoted_turn", "before").alias("reply_turn"),
        F.coalesce("thread", "conv_id").alias("thread_id"),
    )


def build_chats(messages: DataFrame, part: int = PART, most: int = MOST) -> DataFrame:
    """One row per part of a conversation, and per slice of a part of more than ``most`` messages, in
    reply order and without quotes: thread_id, conv_id, part, slice, n_messages, n_linked, replies
    (turn and what it answers) and chat (role-tagged text)."""
    linked = link_messages(messages).withColumn("part", F.floor(F.col("turn") / part))
    large = linked.groupBy("conv_id", "part").agg(F.ceil(F.count(F.lit(1)) / most).alias("slices")).where("slices > 1")
    large = large.withColumnsRenamed({"conv_id": "large_conv", "part": "large_part"})
    sliced = linked.join(large, F.col("conv_id").eqNullSafe(F.col("large_conv")) & F.col("part").eqNullSafe(F.col("large_part")), "left")
    sliced = sliced.withColumn("slice", F.coalesce(F.pmod(F.xxhash64("at"), F.col("slices")), F.lit(0)))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "body", "reply_conv", "reply_turn")
    grouped = sliced.groupBy("thread_id", "conv_id", "part", "slice").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(one)).alias("m"))
    replies = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["reply_conv"].cast("string"), x["reply_turn"].cast("string"))), ",")
    chat = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["body"], F.lit("\n"))), "")
    return grouped.select("thread_id", "conv_id", "part", "slice", "n_messages", "n_linked", replies.alias("replies"), chat.alias("chat"))
