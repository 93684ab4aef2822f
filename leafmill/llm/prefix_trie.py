"""The prefix trie of conversations, by ROLLUP over positional columns of turn ids.

A conversation is cut into blocks of WIDTH turns, one row each, with the ids (MD5 of role and text)
of its turns in positional columns. One ROLLUP over those columns, keyed by the node at which the
block begins, aggregates all prefixes of all conversations together; grouping_id tells how long a
prefix is. The node of a prefix is the XOR of 128-bit hashes of its (position, turn id) pairs, so the
node at which a block begins is known without waiting for the blocks before it, and one pass serves
conversations of any length. Sums over subtrees come from a second ROLLUP over the nodes that two
conversations or more share, block by block from the deepest up; below those a trie is a plain
chain, which needs no pass.

Ranks and running hashes are taken in two steps, within slices of a conversation and over the
slices, so a long conversation is no group of one task. Equal rows are counted before they meet.
Ids of the conversations that end at a node are joined in slices of SLICE ids and hashed as a
stream, so a node at which very many end needs no row or memory of their size.

Defined cases: turns go by number (null first), equal ones by turn id; repeated rows are repeated
turns; null role or text is empty; rows without conv_id belong to no conversation and are left out;
no conversations, no nodes; further columns are left alone. Conversations that share their first n
blocks take n passes of the second ROLLUP.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import materialize

WIDTH = 8
#: The contract's rebuilding: conversations of a group, and the modulus of the turns they share.
GROUP, SHARED = 5, 9
#: Turn numbers or blocks in a slice, and conversation ids in a slice of ids.
NUMBERS, SLICE = 256, 4096
#: Equal turns that are written out from one row.
RUN = 1024
EMPTY = hashlib.sha256(b"").hexdigest()
_T = [f"t{i}" for i in range(WIDTH)]
_PATH = ", ".join(_T)


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that tell (role, text) apart; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def _running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], add) -> DataFrame:
    """df without its column ``slice``, with running aggregates (new name: column) over the rows of
    the same keys that come before, by (slice, order); 0 if there are none. add: F.sum or F.bit_xor."""
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*keys, "slice").agg(*(add(c).alias(f"whole_{n}") for n, c in values.items()))
    earlier = whole.select(*keys, "slice", *(F.coalesce(add(f"whole_{n}").over(over), F.lit(0)).alias(f"earlier_{n}") for n in values))
    here = df.select("*", *(F.coalesce(add(c).over(within), F.lit(0)).alias(f"here_{n}") for n, c in values.items()))

    def joined(n: str) -> Column:
        x, y = F.col(f"earlier_{n}"), F.col(f"here_{n}")
        return x + y if add is F.sum else x.bitwiseXOR(y)

    return here.join(earlier, [*keys, "slice"]).select(*df.drop("slice").columns, *(joined(n).alias(n) for n in values))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_id and size (UTF-8 bytes of the text) of every turn."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", turn_id(F.col("role"), F.col("text")).alias("turn_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = rows.groupBy("conv_id", "turn", "turn_id").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    lot = F.when(F.col("turn").isNull(), F.conv(F.hex(F.substring("turn_id", 1, 2)), 16, 10).cast("int")).otherwise(0)
    rows = rows.withColumn("slice", F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.floor(F.col("turn") / NUMBERS), F.lit(0)).alias("turns"), lot.alias("lot")))
    rows = _running(rows, ["conv_id"], ["turn", "turn_id"], {"start": "n"}, F.sum)
    runs = rows.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("long"), F.lit(RUN).cast("long"))).alias("run"))
    return runs.select("conv_id", F.explode(F.sequence(F.col("start") + F.col("run"), F.col("start") + F.least(F.col("run") + RUN, "n") - 1)).alias("pos"), "turn_id", "size")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conv_ids) of the conversations that the contract builds: the first crc32(conv_id) % 9
    turns of conversation conv_id - conv_id % 5, then the conversation's own after as many."""
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    convs = convs.select("conv_id", "own", (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.least("h", F.coalesce("head", F.lit(0))))
    convs = materialize(convs, "convs")
    own = turns.join(convs.drop("base", "own"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn_id", "size")
    first = turns.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos < h")
    return own.unionByName(first.select("conv_id", "pos", "turn_id", "size")), convs.select("conv_id")


def _marks(pos: Column, turn: Column) -> list[Column]:
    return [F.xxhash64(pos, turn), F.xxhash64(turn, F.lit("trie"), pos)]


def _key(level: Column) -> list[Column]:
    """The node of a block's first ``level`` turns."""
    marks = [_marks(F.col("block") * WIDTH + i, F.col(t)) for i, t in enumerate(_T)]
    return [reduce(lambda a, i: a.bitwiseXOR(F.when(i < level, marks[i][k]).otherwise(0)), range(WIDTH), F.col(p)) for k, p in enumerate(("p1", "p2"))]


def blocks_of(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """A row for every WIDTH turns: conv_id, block, the node before it (p1, p2), turn ids t0.. and
    sizes s0..; a conversation without turns has one empty block."""
    m1, m2 = _marks(F.col("pos"), F.col("turn_id"))
    block, at = F.floor(F.col("pos") / WIDTH), F.col("pos") % WIDTH
    rows = turns.select("conv_id", block.alias("block"), at.alias("at"), "turn_id", "size", m1.alias("m1"), m2.alias("m2"))
    none = conv_ids.select("conv_id", F.lit(0).cast("long").alias("block"))
    rows = rows.unionByName(none, allowMissingColumns=True)
    cells = [F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c[0]}{i}") for c in ("turn_id", "size") for i in range(WIDTH)]
    rows = rows.groupBy("conv_id", "block").agg(*cells, F.coalesce(F.bit_xor("m1"), F.lit(0)).alias("m1"), F.coalesce(F.bit_xor("m2"), F.lit(0)).alias("m2"))
    return _running(rows.withColumn("slice", F.floor(F.col("block") / NUMBERS)), ["conv_id"], ["block"], {"p1": "m1", "p2": "m2"}, F.bit_xor)


def nodes_of(blocks: DataFrame) -> DataFrame:
    """All nodes by one ROLLUP: k1, k2 (the node), q1, q2 (its parent), depth, conv_id (the smallest
    member), n_convs, turn_id and size of the last turn, and the path within its block."""
    sizes = ", ".join(f"max(s{i}) as s{i}" for i in range(WIDTH))
    grouped = blocks.sparkSession.sql(
        f"select block, p1, p2, {_PATH}, {WIDTH} - bit_count(grouping_id()) as level, count(*) as n_convs, min(conv_id) as conv_id, {sizes} from {{blocks}} group by block, p1, p2, rollup({_PATH})",
        blocks=blocks,
    )
    level = F.col("level")
    last = F.coalesce(*(F.when(level == i + 1, F.col(t)) for i, t in enumerate(_T)))
    size = F.coalesce(*(F.when(level == i + 1, F.col(f"s{i}")) for i in range(WIDTH)), F.lit(0)).cast("long")
    grouped = grouped.where(last.isNotNull() | ((level == 0) & (F.col("block") == 0)))
    (k1, k2), (q1, q2) = _key(level), _key(level - 1)
    return grouped.select(k1.alias("k1"), k2.alias("k2"), q1.alias("q1"), q2.alias("q2"), (F.col("block") * WIDTH + level).alias("depth"), "conv_id", "n_convs", last.alias("turn_id"), size.alias("size"), "block", "level", "p1", "p2", *_T)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """k1, k2, n_leaves, saved of the nodes among ``nodes`` (with leaf and saved of their own): sums
    over what hangs below them, block by block from the deepest."""
    deepest = nodes.agg(F.max("block")).first()[0] or 0
    out, hanging = [], None
    for b in range(deepest, -1, -1):
        rows = nodes.where(F.col("block") == b)
        if hanging is not None:
            rows = rows.join(hanging, ["k1", "k2"], "left")
            rows = rows.withColumn("leaf", F.col("leaf") + F.coalesce("below_leaf", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("below_saved", F.lit(0)))
        sums = nodes.sparkSession.sql(f"select block, p1, p2, {_PATH}, {WIDTH} - bit_count(grouping_id()) as level, sum(leaf) as n_leaves, sum(saved) as saved from {{rows}} group by block, p1, p2, rollup({_PATH})", rows=rows)
        k1, k2 = _key(F.col("level"))
        last = F.coalesce(*(F.when(F.col("level") == i + 1, F.col(t)) for i, t in enumerate(_T)))
        sums = sums.where(last.isNotNull() | (F.col("level") == 0)).select(k1.alias("k1"), k2.alias("k2"), "level", "n_leaves", "saved")
        sums = materialize(sums, "subtrees") if b else sums
        hanging = sums.where("level = 0").select("k1", "k2", F.col("n_leaves").alias("below_leaf"), F.col("saved").alias("below_saved"))
        out.append((sums.where("level > 0") if b else sums).drop("level"))
    return reduce(DataFrame.unionByName, out)


def _ends(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes at which conversations end."""
    m1, m2 = _marks(F.col("pos"), F.col("turn_id"))
    rows = turns.select("conv_id", m1.alias("m1"), m2.alias("m2")).unionByName(conv_ids.select("conv_id"), allowMissingColumns=True)
    rows = rows.groupBy("conv_id").agg(F.coalesce(F.bit_xor("m1"), F.lit(0)).alias("k1"), F.coalesce(F.bit_xor("m2"), F.lit(0)).alias("k2"))
    rows = rows.groupBy("k1", "k2", F.floor(F.col("conv_id") / SLICE).alias("slice")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if (k1, k2) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([{"k1": a, "k2": b, "ends_sha256": s} for a, b, s in out], schema=schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": sha.hexdigest()}], schema=schema)

    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    return rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "slice").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, turn_id (of its last turn).

    turns: conv_id, pos (0, 1, ...), turn_id, size; conv_ids: all conversations, once each."""
    nodes = materialize(nodes_of(blocks_of(turns, conv_ids)), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.where("depth = 0 or n_convs > 1").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("up"), F.lit(True).alias("branch"))
    rows = nodes.join(children, ["k1", "k2"], "left").join(parents, ["q1", "q2"], "left")
    # a node of one conversation, below another such node, has that conversation as its parent's
    rows = rows.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    rows = materialize(rows.drop("up"), "linked")
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    leaf = F.when(shared, (F.col("n_children") == 0).cast("long")).otherwise(1)
    heads = rows.where(shared | F.col("branch")).withColumns({"leaf": leaf, "saved": (F.col("n_convs") - 1) * F.col("size")})
    sums = _subtrees(heads.select("k1", "k2", "block", "p1", "p2", *_T, "leaf", "saved"))
    out = rows.join(sums, ["k1", "k2"], "left").join(_ends(turns, conv_ids), ["k1", "k2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "turn_id")


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with role and text of their last turn (null at the root)."""
    texts = conversations.select(turn_id(F.col("role"), F.col("text")).alias("turn_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["turn_id"])
    return nodes.join(texts, "turn_id", "left")


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialize(numbered(conversations), "turns")
    return trie(turns, turns.select("conv_id").distinct())


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``rebuild`` makes."""
    turns, conv_ids = rebuild(materialize(numbered(conversations), "turns"))
    return trie(materialize(turns, "rebuilt"), conv_ids)
