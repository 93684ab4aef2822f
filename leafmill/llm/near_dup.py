"""MinHash near-duplicate detection.

1. Each document becomes a set of word shingles, sketched by 128 universal hash minima in 32 bands
   of 4. Documents with equal sets are one node, and nodes that share an id are linked.
2. Each bucket (band, minima) links its members to its smallest one: as many candidates as
   members, whatever the bucket's size. Candidates whose signatures agree in too few places are
   dropped; the rest are confirmed on the full sets.
3. In buckets whose members still lie in several components, each member is first tried with one
   neighbour, whose signature agrees most. What is apart after that is compared member by member, in
   blocks dealt over the cluster, on the full sets; members of the bucket's largest component meet
   only members of the others, and only links that join two components come out.
4. Components are found by alternating large-star and small-star.

A pair at the threshold shares no bucket with probability (1 - 0.8^4)^32 = 5e-8.

Defined cases: null or empty texts, or texts without words, have an empty set and stay alone; a
text of fewer words than a shingle is one shingle; repeated ids belong together, whatever their
texts; a null doc_id has a null component and is not kept; further columns are left alone.
drop_near_duplicates() tells rows apart by keys of its own, so there repeated ids are different
documents, exact copies are dropped whatever their ids, and null ids stay unless a copy does.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.llm.components import connected_components
from leafmill.tables import materialize

BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Five standard deviations below 128 * 0.8.
LEAST_EQUAL = 80
#: Members of a bucket that are compared with each other in one task.
BLOCK = 512
#: What tells sets apart.
SET = ["h1", "h2", "n_shingles"]
SKETCH = "doc_id long, n_shingles long, h1 long, h2 long, signature binary, bands array<long>"

_rng = np.random.default_rng(97)
FACTORS = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and their len + 1 offsets."""
    split = bytewords.split_words(column)
    n, h = len(split.hashes), split.hashes
    runs = bytewords.chain(*(h[k : n - words + 1 + k] for k in range(words))) if n >= words else h[:0]
    sets = []
    for begin, end in zip(split.offsets[:-1].tolist(), split.offsets[1:].tolist(), strict=True):
        if end - begin >= words:
            sets.append(np.unique(runs[begin : end - words + 1]))
        elif end > begin:
            sets.append(bytewords.chain(*(h[i : i + 1] for i in range(begin, end))))
        else:
            sets.append(h[:0])
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else h[:0], offsets


def minima(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MINIMA x documents; documents without shingles get zeros."""
    out = np.zeros((MINIMA, len(offsets) - 1), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    begin = 0
    while begin < len(full):  # pieces that stay in the processor's cache
        end = max(begin + 1, int(np.searchsorted(offsets[full], offsets[full[begin]] + (1 << 15))))
        rows = full[begin:end]
        piece = shingles[offsets[rows[0]] : offsets[rows[-1] + 1]]
        at = offsets[rows] - offsets[rows[0]]
        for k in range(MINIMA):
            out[k, rows] = np.minimum.reduceat(piece * FACTORS[k] + TERMS[k], at)
        begin = end
    return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _set_hashes(shingles: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """h1 and h2 of each set."""
    return [pa.array(_sums(bytewords.mix(shingles + np.uint64(k)), offsets)) for k in (0, MINIMA)]


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """SKETCH, one row per document."""

    def rows(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole, 2 << 20):
                shingles, offsets = shingle_sets(batch.column("text"), words)
                low = minima(shingles, offsets)
                bands = bytewords.chain(np.repeat(np.arange(BANDS, dtype=np.uint64), low.shape[1]).reshape(BANDS, -1), *(low[k::ROWS] for k in range(ROWS)))
                n = batch.num_rows
                signature = np.ascontiguousarray((low >> np.uint64(40)).astype(np.uint8).T)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        *_set_hashes(shingles, offsets),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, MINIMA * (n + 1), MINIMA, dtype=np.int32)), pa.py_buffer(signature)]),
                        pa.ListArray.from_arrays(np.arange(0, BANDS * (n + 1), BANDS, dtype=np.int32), pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "signature", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, SKETCH)


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in LEAST_EQUAL places or more."""

    def keep(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MINIMA) for c in ("sa", "sb"))
            mask = (x == y).sum(axis=1) >= LEAST_EQUAL
            yield batch.select(["a", "b"]).filter(pa.array(mask))

    with_a = pairs.join(signatures.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
    both = with_a.join(signatures.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the nodes (node, rep, *SET), from the whole texts of their reps."""

    def rows(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole, 2 << 20):
                shingles, offsets = shingle_sets(batch.column("text"), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets)), *_set_hashes(shingles, offsets), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(shingles.view(np.int64)))],
                    names=["doc_id", "n_shingles", "h1", "h2", "shingles"],
                )

    wanted = docs.select("doc_id", "text").join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = wanted.mapInArrow(rows, "doc_id long, n_shingles long, h1 long, h2 long, shingles array<long>").dropDuplicates(["doc_id", *SET])
    return sets.join(nodes.withColumnRenamed("rep", "doc_id"), ["doc_id", *SET]).select(F.col("node").alias("id"), "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, as edges (u, v)."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their components, of buckets in which undecided pairs may be left: those of
    three members or more that lie in two components or more."""
    placed = members.where("n > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = materialize(placed.select("bucket", "n", "center", "rep", "component"), "placed")
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return placed.join(mixed.select("bucket", F.col("main.component").alias("main"), F.col("main.size").alias("main_size")), "bucket")


def _dealt(members: DataFrame) -> DataFrame:
    """A bucket as pairs (i, j) of blocks of about BLOCK members: all pairs of the blocks outside its
    largest component, and each of them with each block of that component."""
    in_main = F.col("component") == F.col("main")
    rest, main = F.ceil((F.col("n") - F.col("main_size")) / BLOCK).cast("int"), F.ceil(F.col("main_size") / BLOCK).cast("int")
    dealt = members.withColumns({"rest_blocks": rest, "main_blocks": main})
    own = F.pmod(F.xxhash64("rep"), F.when(in_main, F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int")
    dealt = dealt.withColumn("block", F.when(in_main, F.col("rest_blocks") + own).otherwise(own))
    others = F.col("rest_blocks") + F.when(in_main, 0).otherwise(F.col("main_blocks"))
    dealt = dealt.select("bucket", "rep", "center", "component", "signature", "shingles", "block", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    return dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "center", "component", "signature", "shingles")


def _block_pair(table: pa.Table):
    """Ids, components, signatures, the two sides, and whether members agree in signature.

    The last is a function of one member and several others: places that agree, 0 where both are
    in one component, or where one is the bucket's center, whose pairs have been decided."""
    reps, comps, block = (table.column(c).to_numpy() for c in ("rep", "component", "block"))
    center = table.column("center")[0].as_py()
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()

    def agree(x: int, others: np.ndarray) -> np.ndarray:
        equal = (signatures[others] == signatures[x]).sum(axis=1)
        return np.where((comps[others] == comps[x]) | (reps[others] == center) | (reps[x] == center), 0, equal)

    return reps, comps, np.flatnonzero(block == i), np.flatnonzero(block == j), agree


def _pairs(found: list[tuple[int, int]], names: tuple[str, str]) -> pa.Table:
    return pa.table({names[0]: pa.array([max(p) for p in found], pa.int64()), names[1]: pa.array([min(p) for p in found], pa.int64())})


def _best_partners(members: DataFrame) -> DataFrame:
    """(a, b): for each member, in its largest bucket and its own block there, the one of another
    component whose signature agrees most."""

    def best(table: pa.Table) -> pa.Table:
        reps, _, left, _, agree = _block_pair(table)
        found = []
        for x in left.tolist():
            equal = agree(x, left)
            top = int(equal.argmax())
            if equal[top] >= LEAST_EQUAL:
                found.append((int(reps[x]), int(reps[left[top]])))
        return _pairs(found, ("a", "b"))

    largest = members.groupBy("rep", "component", "signature").agg(F.max(F.struct("n", "bucket", "center")).alias("x")).select("rep", "component", "signature", "x.*")
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = largest.withColumns({"block": block, "i": block, "j": block}).select("bucket", "i", "j", "block", "rep", "center", "component", "signature")
    return dealt.groupBy("bucket", "i", "j").applyInArrow(best, "a long, b long").distinct()


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that join all components that similar members of one bucket lie in.

    members also have their full sets here, so pairs are decided where they meet, and only those
    come out that join what was apart: fewer than there are members."""

    def join(table: pa.Table) -> pa.Table:
        reps, comps, left, right, agree = _block_pair(table)
        sets = [np.asarray(x.values) for x in table.column("shingles")]
        root = {int(c): int(c) for c in np.unique(comps)}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for x in left.tolist():
            equal = agree(x, right)
            for k in np.argsort(-equal, kind="stable").tolist():
                if equal[k] < LEAST_EQUAL:
                    break
                y = int(right[k])
                a, b = top(int(comps[x])), top(int(comps[y]))
                if a != b:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                        root[max(a, b)] = min(a, b)
                        found.append((int(reps[x]), int(reps[y])))
        return _pairs(found, ("u", "v"))

    return _dealt(members).groupBy("bucket", "i", "j").applyInArrow(join, "u long, v long").distinct()


def _same_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the nodes of ids that have several."""
    sets = F.struct(*SET)
    several = known.groupBy("doc_id").agg(F.min(sets).alias("low"), F.max(sets).alias("high")).where("low < high").select("doc_id")
    nodes = known.join(several, "doc_id", "left_semi").select("doc_id", *SET).distinct().join(classes.select("node", *SET), SET)
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").where("node <> u").select("u", F.col("node").alias("v"))


def components_of(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = materialize(sketch(docs, words), "sketch")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    classes = known.groupBy(*SET).agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = rows.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *SET]).dropDuplicates(["node"])
    signatures = materialize(reps.select(F.col("node").alias("rep"), "signature", "bands"), "signatures")
    banded = signatures.select("rep", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("center")).where("n > 1")
    members = materialize(banded.join(buckets, "bucket"), "members")
    stars = members.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    near = materialize(_agreeing(stars, signatures), "candidates")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.where("n > 2").select(F.col("rep").alias("id"))).distinct()
    nodes = classes.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
    sets = materialize(_sets_of(docs, nodes, words), "sets")
    edges = materialize(_confirmed(near, sets, percent).unionByName(_same_ids(known, classes)), "links")
    found = materialize(connected_components(edges), "components")

    left = _open(members, found)
    best = materialize(_best_partners(left.join(signatures.select("rep", "signature"), "rep")), "partners")
    if not best.isEmpty():
        edges = materialize(edges.unionByName(_confirmed(best, sets, percent)), "links")
        found = materialize(connected_components(edges), "components")
        left = _open(members, found)
    left = left.join(signatures.select("rep", "signature"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep")
    more = materialize(_across(left, percent), "across")
    if not more.isEmpty():
        found = materialize(connected_components(edges.unionByName(more)), "components")

    classes = classes.join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    classes = classes.join(classes.groupBy("part").agg(F.min("rep").alias("component")), "part").select(*SET, "component")
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(classes, SET, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component."""
    key = "near_dup_key"
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    placed = components_of(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent)
    placed = placed.select(F.col("doc_id").alias(key), "component_id").join(keyed.select(key, "doc_id"), key)
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("x"))
    return keyed.join(first.select(F.col(f"x.{key}").alias(key)), key, "left_semi").select(docs.columns)
