"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, in a hashed order, are cut into blocks. With weight w, a source's j-th
block (from 0) is released at slot floor(j / w) and due at slot ceil((j + 1) / w). Each slot takes,
of the released blocks, the one due first. Weights are multiples of 1 / period that sum to 1, so
one period of slots is scheduled once and then repeats; a source is never a whole block ahead of or
behind its share, as long as it lasts. A source that has run out leaves its slots empty; no
document is dropped or repeated.

The schedule is the same for any number of sources and any period, and is made in joins and windows
over slots: blocks are ranked by deadline and dealt to CLASSES classes, the earliest deadlines first.
Blocks of later classes never delay those of earlier ones, so the slots that the first c classes take
follow from the numbers released (a slot is left over where slots outrun releases as never before).
Each class then has slots of its own and is dealt in the same way, until each block has its slot.

The period is PERIOD, or, as each source takes a slot of it at least, for more than PERIOD sources
the power of two that has SLOTS for each source.

Order within sources: documents are ranked inside hashed buckets of bounded size, and buckets get
offsets, so a source of any size is spread over the cluster.

Defined cases: a null source is a source of its own, with the empty one; rows without an id are
ordered by their texts; repeated rows are placed one after the other (and so share a bucket); texts
are carried whole, whatever their length; weights that leave out a source of the table, or that sum
to more than the period, are an error; an empty table gives no rows; all columns are carried along,
whatever their names, but block, slot and place are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import materialize

PERIOD = 1000
#: For each source on average at least, in a period of more than PERIOD sources.
SLOTS = 16
#: Classes of deadlines that are told apart in one pass over the slots (a power of two).
CLASSES = 8
#: Slots in a range, within which numbers are added up one after the other.
RANGE = 1 << 16
BLOCK = 16
#: Documents in a bucket, on average.
BUCKET = 4096
TEMPERATURE = 0.5


def hash_order(doc_id: Column) -> Column:
    """A fixed shuffling key: 60 bits of the md5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def target_weights(counts: DataFrame, temperature: float = TEMPERATURE, period: int = PERIOD) -> DataFrame:
    """(source, weight): whole shares of the period, in proportion to n ** temperature, one at
    least. counts: (source, n), one row per source; shares left over go to the largest remainders."""
    scaled = counts.select("source", F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("x"))
    every = Window.partitionBy()
    sources = F.count(F.lit(1)).over(every)
    exact = (period - sources) * F.col("x") / F.sum("x").over(every)
    scaled = scaled.select("source", F.round(exact, 6).alias("exact")).withColumn("whole", F.floor("exact"))
    left = period - F.count(F.lit(1)).over(every) - F.sum("whole").over(every)
    place = F.row_number().over(Window.orderBy((F.col("whole") - F.col("exact")), "source"))
    return scaled.select("source", (1 + F.col("whole") + F.when(place <= left, 1).otherwise(0)).cast("int").alias("weight"))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with ``rank``, from 0, by columns that are distinct in all; each task ranks a range of its own."""
    ranges = materialize(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select("range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("rank", within).join(offsets, "range").withColumn("rank", F.col("rank") + F.col("offset")).drop("range", "offset")


def _deal(slots: DataFrame, blocks: DataFrame, digit: Column) -> DataFrame:
    """(at, pos, slot, class, left): the class of each slot; left[c] counts the slots of its group
    before it that the classes before c leave over.

    slots: (at, pos, slot), each group's positions from 0 on; blocks: (at, pos, rank), pos: where a
    block is released; digit: a block's class, of its rank."""
    cuts = range(CLASSES - 1)
    upto = "over (partition by at, range order by pos rows between unbounded preceding and current row)"
    earlier = "over (partition by at order by range rows between unbounded preceding and 1 preceding)"
    free = slots.select("at", "pos", "slot", F.lit(None).cast("int").alias("class"))
    rows = free.unionByName(blocks.select("at", "pos", F.lit(None).cast("long").alias("slot"), digit.cast("int").alias("class")))
    released = rows.groupBy("at", "pos").agg(F.max("slot").alias("slot"), *(F.expr(f"count_if(class <= {c}) as n{c}") for c in cuts))
    # slots up to here less blocks released: each new maximum above 0 is a slot left over
    own = released.selectExpr("*", f"pos div {RANGE} as range")
    own = own.selectExpr("at", "range", "pos", "slot", *(f"sum(n{c}) {upto} as n{c}" for c in cuts))
    own = own.selectExpr("*", *(f"max(pos + 1 - n{c}) {upto} as now{c}" for c in cuts))
    # ranges get what the ranges before them release and leave over
    totals = own.groupBy("at", "range").agg(*(F.expr(f"max({x}{c}) as {x}{c}") for c in cuts for x in ("n", "now")))
    totals = totals.selectExpr("at", "range", *(f"coalesce(sum(n{c}) {earlier}, 0) as base{c}" for c in cuts), *(f"now{c}" for c in cuts))
    totals = totals.selectExpr("at", "range", f"array({', '.join(f'base{c}' for c in cuts)}) as base", f"array({', '.join(f'greatest(0, max(now{c} - base{c}) {earlier})' for c in cuts)}) as left")
    own = own.selectExpr("at", "range", "pos", "slot", f"array({', '.join(f'now{c}' for c in cuts)}) as now")
    own = own.withColumn("was", F.lag("now").over(Window.partitionBy("at", "range").orderBy("pos")))
    add = "zip_with(left, zip_with({}, base, (x, y) -> x - y), (x, y) -> greatest(x, y))"
    placed = own.join(totals, ["at", "range"]).selectExpr("at", "pos", "slot", f"{add.format('now')} as now", f"coalesce({add.format('was')}, left) as was")
    first = "array_position(zip_with(now, was, (x, y) -> x = y), true)"  # from 1; 0 where no class but the last takes the slot
    return placed.selectExpr("at", "pos", "slot", f"cast(if({first} = 0, {CLASSES}, {first}) as int) - 1 as class", "concat(array(pos), was, array(0L)) as left")


def schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, turn, slot): the slots of one period, by earliest deadline among released blocks,
    of equal deadlines by source. weights: (source, weight) of a sum of at most period."""
    spark = weights.sparkSession
    bits, part = (CLASSES - 1).bit_length(), 1 << 12
    levels = max(1, -(-period.bit_length() // bits))  # so that no block has the last number, where empty slots end
    # the turns of a source in parts, so that one of a large weight is no row's list
    parts = weights.where("weight > 0").select("source", F.col("weight").cast("long").alias("weight"), F.expr(f"explode(sequence(0, (cast(weight as long) - 1) div {part}))").alias("part"))
    turns = parts.repartition("source", "part").select("source", "weight", F.expr(f"explode(sequence(part * {part}, least(weight, (part + 1) * {part}) - 1))").alias("turn"))
    due = turns.select("source", "turn", F.expr(f"turn * {period}L div weight").alias("release"), F.expr(f"((turn + 1) * {period}L + weight - 1) div weight").alias("deadline"))
    ranked = materialize(_numbered(due, "deadline", "source"), "ranked")
    blocks = ranked.select(F.lit(0).cast("long").alias("at"), F.col("release").alias("pos"), "rank")
    slots = spark.range(period).select(F.lit(0).cast("long").alias("at"), F.col("id").alias("pos"), F.col("id").alias("slot"))
    for level in reversed(range(levels)):
        digit = F.shiftright("rank", level * bits).bitwiseAND(CLASSES - 1)
        dealt = materialize(_deal(slots, blocks, digit), "dealt")
        own = lambda c: (F.get("left", c) - F.get("left", c + 1)).alias("pos")
        slots = dealt.select((F.col("at") * CLASSES + F.col("class")).alias("at"), own(F.col("class")), "slot")
        if level:
            moved = blocks.join(dealt.select("at", "pos", "left"), ["at", "pos"])
            blocks = materialize(moved.select((F.col("at") * CLASSES + digit).alias("at"), own(digit.cast("int")), "rank"), "blocks")
    return slots.select(F.col("at").alias("rank"), "slot").join(ranked, "rank").select("source", "turn", "slot")


def _quotient(x: Column, y: Column) -> Column:
    """floor(x / y) of whole numbers, where it is under 2^52."""
    return F.round((x - x % y) / y).cast("long")


def paths(weights: DataFrame, period: int) -> DataFrame:
    """A schedule in closed form, which mix() does not use: a source may be a few blocks from its share.
    Sources are split in two by weight, and each half again: of a node's slots, the earlier half's j-th is
    the floor(j W / w)-th, the later half's the (ceil((j + 1) W / w) - 1)-th.

    (source, weight, path): the halves that a source is in, smallest first, as an array of
    (w, of, earlier): a half's weight, that of both, and whether it is the earlier one."""
    order = Window.orderBy(F.desc("weight"), "source")
    middle = 2 * F.sum(F.col("weight").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight")
    depth = (2 * period).bit_length()
    placed = materialize(weights.select("source", "weight", middle.alias("middle")), "middles")  # distinct, in (0, 2 * period)
    cells = placed.select("source", "weight", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "middle")
    cells = cells.withColumn("cell", F.expr("shiftright(middle, level)"))
    sums = cells.groupBy("level", "cell").agg(F.sum("weight").alias("w"))
    both = F.sum("w").over(Window.partitionBy("level", F.expr("shiftright(cell, 1)")))
    halves = sums.withColumn("of", both).where("w < of").withColumn("earlier", F.col("cell") % 2 == 0)
    found = cells.select("source", "level", "cell").join(halves, ["level", "cell"])
    path = found.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("level", "w", "of", "earlier"))).alias("path"))  # depth halves at most
    return placed.select("source", "weight").join(path, "source", "left").withColumn("path", F.coalesce("path", F.expr("cast(array() as array<struct<level:int,w:bigint,of:bigint,earlier:boolean>>)")))


def slot_on(path: Column, turn: Column) -> Column:
    """The slot in a period of a source's turn-th block there."""

    def up(t: Column, half: Column) -> Column:
        return F.when(half["earlier"], _quotient(t * half["of"], half["w"])).otherwise(_quotient((t + 1) * half["of"] + half["w"] - 1, half["w"]) - 1)

    return F.aggregate(path, turn.cast("long"), up)


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """All documents with all columns, and block, slot and place (in the block).

    weights: (source, weight), whole numbers that sum to period, with all sources; by default
    target_weights(), of a longer period if there are more sources than slots in it."""
    # a row's own columns travel in a struct, so none of them can clash with the working columns
    id_key = hash_order(F.col("doc_id"))
    if "text" in docs.columns:  # rows without an id are told apart by their texts, or else share a bucket
        id_key = F.when(F.col("doc_id").isNull(), hash_order(F.md5(F.coalesce("text", F.lit(""))))).otherwise(id_key)
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce("source", F.lit("")).alias("mix_source"), id_key.alias("mix_key"))
    counts = materialize(keyed.groupBy(F.col("mix_source").alias("source")).agg(F.count(F.lit(1)).alias("n")), "sources")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        sources = counts.count()
        period = period if period >= sources else 1 << (SLOTS * sources - 1).bit_length()
        weights = target_weights(counts, period=period)
    weights = materialize(weights.withColumn("source", F.coalesce("source", F.lit(""))), "weights")
    if unlisted := counts.join(weights.where("weight > 0"), "source", "left_anti").select("source").limit(3).collect():
        raise ValueError(f"sources without a weight: {', '.join(r.source for r in unlisted)}")
    if (weights.agg(F.sum("weight")).first()[0] or 0) > period:
        raise ValueError(f"weights of more than {period} in all")

    buckets = max(1, -(-total // BUCKET))
    keyed = keyed.withColumn("mix_bucket", F.floor(F.col("mix_key") / ((1 << 60) / buckets)).cast("long"))
    sizes = keyed.groupBy("mix_source", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_size"))
    # running totals in two steps, so that not all buckets of a source meet in one task
    sizes = sizes.withColumn("mix_group", F.floor(F.col("mix_bucket") / BUCKET))
    groups = sizes.groupBy("mix_source", "mix_group").agg(F.sum("mix_size").alias("mix_size"))
    before = lambda by, order: F.coalesce(F.sum("mix_size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("mix_source", "mix_group", before(["mix_source"], "mix_group").alias("mix_ahead"))
    sizes = sizes.select("mix_source", "mix_bucket", "mix_group", before(["mix_source", "mix_group"], "mix_bucket").alias("mix_within"))
    offsets = sizes.join(groups, ["mix_source", "mix_group"]).select("mix_source", "mix_bucket", (F.col("mix_ahead") + F.col("mix_within")).alias("mix_offset"))
    within = F.row_number().over(Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc.doc_id")) - 1
    ranked = keyed.withColumn("mix_rank", within).join(offsets, ["mix_source", "mix_bucket"])
    rank = F.col("mix_offset") + F.col("mix_rank")
    ranked = ranked.withColumn("block", F.floor(rank / block).cast("long")).withColumn("place", F.pmod(rank, F.lit(block)).cast("int"))
    plan = materialize(schedule(weights, period), "plan")
    ranked = ranked.join(weights.withColumnsRenamed({"source": "mix_source", "weight": "mix_weight"}), "mix_source")
    ranked = ranked.withColumn("mix_turn", F.pmod("block", F.col("mix_weight").cast("long")))
    slotted = ranked.join(plan.withColumnsRenamed({"source": "mix_source", "turn": "mix_turn", "slot": "mix_slot"}), ["mix_source", "mix_turn"])
    slot = F.floor(F.col("block") / F.col("mix_weight")) * period + F.col("mix_slot")
    carried = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in ("block", "slot", "place")]
    return slotted.select(*carried, "block", slot.cast("long").alias("slot"), "place")
