"""All pairs of records whose sets overlap above a similarity threshold, by binary sketches.

Each set gets one bit of each of many min-hashes. The bits are packed into segments; two sets are candidates if they
share a segment and their check codes lie within a Hamming radius; candidates are verified on the sets themselves, so
every pair that comes out is a true one. Two sets of similarity t agree in a bit with probability (1 + t) / 2, from
which number of segments and radius are calibrated: a pair at the threshold is missed with probability of at most
``MISS`` by the segments and ``MISS`` by the radius, a more similar one with less.

No side of a join is small by construction, so all of them are pinned to shuffles. A group that all its members would
meet in (a segment many sets share, a set many records have) is cut into blocks, and each pair of blocks is a group of
its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.session import cut_lineage

#: Chance that a pair exactly at the threshold is missed by either calibrated bound.
MISS = 1e-6
CHECK_BITS = 64
#: Rows of a group beyond which it is cut into blocks of this many.
BLOCK_ROWS = 4096
#: A segment is looked at for being hot if so many of the sets that a task sketches at once share it.
SEEN_TOGETHER = 16


def calibrate(n_sets: int, threshold: float, miss: float = MISS) -> tuple[int, int, int]:
    """(bits of a segment, segments, Hamming radius of the check code).

    A segment has about log2(n_sets) - 3 bits, so that unrelated sets meet about eight times per segment at any size:
    comparing two codes is cheaper than the further segments that longer ones would need.
    """
    agree = (1 + threshold) / 2
    bits = max(12, math.ceil(math.log2(max(2, n_sets))) - 3)
    segments = math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    segments = max(segments, math.ceil(CHECK_BITS / bits))
    tail, radius = 1.0, -1
    while tail > miss:
        radius += 1
        tail -= math.comb(CHECK_BITS, radius) * (1 - agree) ** radius * agree ** (CHECK_BITS - radius)
    return bits, segments, radius


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_bits(flat: np.ndarray, starts: np.ndarray, n_bits: int) -> np.ndarray:
    """bits[k, i]: one bit of the k-th min-hash of set i. Sets are slices of ``flat`` and not empty."""
    rng = np.random.default_rng(20_240_601)
    odd = rng.integers(0, 2**63, n_bits, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, n_bits, np.int64).astype(np.uint64)
    base = _mix(flat.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((n_bits, len(starts)), bool)
    work = np.empty_like(base)
    for k in range(n_bits):
        np.bitwise_xor(base, flip[k], out=work)
        np.multiply(work, odd[k], out=work)
        out[k] = (np.minimum.reduceat(work, starts) >> np.uint64(13)) & np.uint64(1)
    return out


def _shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data: never by sending one of them to all tasks."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _n_blocks(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _met(rows: DataFrame, group: str, n: str, name: str, block: int, near: Column | None = None) -> DataFrame:
    """(<name>_a, <name>_b), in this order: the pairs of rows of one group that ``near`` (a condition on columns
    <column>_a and <column>_b) holds for, by pairs of blocks. ``n`` is the number of rows of the group, ``name`` unique
    in it."""
    own = F.pmod(F.xxhash64(name), F.col("_blocks")).cast("int")
    cut = rows.withColumn("_blocks", _n_blocks(F.col(n), block)).withColumn("_own", own).drop(n)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in cut.columns if c not in (group, "_blocks", "_own")]
    a = cut.select(F.col(group).alias("_g"), F.col("_own").alias("_i"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_j"), *side("a"))
    b = cut.select(F.col(group).alias("_h"), F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_k"), F.col("_own").alias("_l"), *side("b"))
    same = (F.col("_g") == F.col("_h")) & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l"))
    once = (F.col("_i") < F.col("_j")) | (F.col(f"{name}_a") < F.col(f"{name}_b"))
    met = _shuffled(a, b, same & once if near is None else same & once & near)
    return met.select(F.least(f"{name}_a", f"{name}_b").alias(f"{name}_a"), F.greatest(f"{name}_a", f"{name}_b").alias(f"{name}_b"))


def distinct_sets(df: DataFrame, key: str, items: str, min_items: int) -> DataFrame:
    """(key, ids): each record with the sorted distinct items of its list; nulls in it and repeats are dropped. Records
    with a null list or fewer than ``min_items`` distinct items fall out."""
    clean = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull())))
    return df.select(F.col(key), clean.alias("ids")).where(F.size("ids") >= min_items)


def set_classes(sets: DataFrame, key: str) -> DataFrame:
    """(class_id, ids, n_copies) of each distinct set. A class is named by its least key."""
    return cut_lineage(sets.groupBy("ids").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n_copies")))


def members_of(sets: DataFrame, classes: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, class_id, n_copies, columns) of each record of ``sets``, the columns from ``classes``.

    Only classes of more than one record are joined back; those that hold a thousandth of all records (at most 1,000)
    are sent to all tasks, so that their records stay where they are.
    """
    kept = [key, "class_id", "n_copies", *columns]
    total = classes.agg(F.sum("n_copies").alias("_all"))
    shares = classes.where("n_copies > 1").crossJoin(F.broadcast(total)).withColumn("_hot", F.col("n_copies") * 1000 >= F.col("_all"))  # one row
    hot, cold = shares.where("_hot").drop("_hot", "_all"), shares.where("not _hot").drop("_hot", "_all")
    alone = classes.where("n_copies = 1").withColumn(key, F.col("class_id")).select(*kept)
    often = sets.join(F.broadcast(hot), "ids").select(*kept)
    return alone.unionByName(often).unionByName(_shuffled(sets.join(F.broadcast(hot), "ids", "left_anti"), cold, "ids").select(*kept))


def _sketched(classes: DataFrame, bits: int, segments: int) -> DataFrame:
    """(class_id, code, keys): check code and segments of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[:, None]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(1)
                ends = lists.offsets.to_numpy().astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                got = sketch_bits(flat, ends[:-1] - ends[0], max(CHECK_BITS, bits * segments))
                code = np.packbits(np.ascontiguousarray(got[:CHECK_BITS].T), axis=1).view(np.int64).ravel()
                cut = got[: bits * segments].reshape(segments, bits, -1).astype(np.uint64)
                keys = np.stack([(cut[s] * weights).sum(0) + np.uint64(s << bits) for s in range(segments)], axis=1)
                offsets = pa.array(np.arange(0, (part.num_rows + 1) * segments, segments, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(code), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))],
                    names=["class_id", "code", "keys"],
                )

    kind = classes.schema["class_id"].dataType.simpleString()
    return classes.select("class_id", "ids").mapInArrow(run, f"class_id {kind}, code bigint, keys array<bigint>")


def _hot_segments(sketched: DataFrame, least: int) -> DataFrame:
    """(segment, n): segments that at least ``least`` sets share.

    A task counts the segments of some sets at a time and reports those met ``SEEN_TOGETHER`` times, which hardly any is
    without being hot; so a count is short by less than that for each such lot, and a segment missed for that
    is but little larger than ``least``. It is then not cut, which costs time but loses nothing.
    """
    together = SEEN_TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            segment, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= together
            return pa.RecordBatch.from_arrays([pa.array(segment[often]), pa.array(n[often].astype(np.int64))], names=["segment", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size >= 8_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return sketched.select("keys").mapInArrow(run, "segment bigint, n bigint").groupBy("segment").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def class_pairs(classes: DataFrame, n_sets: int, numerator: int, denominator: int, block: int = BLOCK_ROWS) -> DataFrame:
    """(class_a, class_b, copies_a, copies_b), class_a < class_b: pairs of distinct sets with Jaccard similarity of at
    least numerator / denominator, and how many records have either."""
    threshold = numerator / denominator
    bits, segments, radius = calibrate(n_sets, threshold)
    sketched = cut_lineage(_sketched(classes, bits, segments))
    rows = sketched.select(F.explode("keys").alias("segment"), "class_id", "code")
    # Every set is in each of the segments' groups, so at most 1,000 groups per segment have a thousandth of all sets:
    # below that, and below a block, groups are worked off whole.
    hot = cut_lineage(_hot_segments(sketched, max(block, n_sets // 1000)))
    near = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= radius
    cold = rows.join(F.broadcast(hot), "segment", "left_anti")
    side = lambda s: cold.select(*[F.col(c).alias(f"{c}_{s}") for c in cold.columns])
    met = _shuffled(side("a"), side("b"), (F.col("segment_a") == F.col("segment_b")) & (F.col("class_id_a") < F.col("class_id_b")) & near).select("class_id_a", "class_id_b")
    if not hot.isEmpty():
        met = met.unionByName(_met(rows.join(F.broadcast(hot), "segment"), "segment", "n", "class_id", block, near))
    candidates = met.groupBy(F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b")).agg(F.count(F.lit(1)).alias("n_segments"))
    named = lambda s: classes.select(F.col("class_id").alias(f"class_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("n_copies").alias(f"copies_{s}"))
    both = F.size(F.array_intersect("ids_a", "ids_b"))
    return (
        _shuffled(_shuffled(candidates, named("a"), "class_a"), named("b"), "class_b")
        .withColumn("both", both)
        .where(F.col("both") * denominator >= (F.size("ids_a") + F.size("ids_b") - F.col("both")) * numerator)
        .select("class_a", "class_b", "copies_a", "copies_b")
    )


def _records(pairs: DataFrame, class_column: str, copies: str, members: DataFrame, key: str, name: str, block: int) -> DataFrame:
    """``pairs`` with ``name``, each record of the class in turn; a class of many records is joined block by block."""
    at = F.pmod(F.xxhash64(key), _n_blocks(F.col("n_copies"), block)).cast("int")
    own = members.select(F.col("class_id").alias(class_column), F.col(key).alias(name), at.alias("_block"))
    wide = pairs.withColumn("_block", F.explode(F.sequence(F.lit(0), _n_blocks(F.col(copies), block) - 1)))
    return _shuffled(wide, own, [class_column, "_block"]).drop("_block")


def similar_pairs(
    df: DataFrame, key: str, items: str, min_items: int, numerator: int, denominator: int, n_sets: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """(<key>_a, <key>_b), a < b: all pairs of records at or above the threshold, equal sets among them.

    ``key`` is unique. Records with a null list or fewer than ``min_items`` distinct items have no partner; an empty
    table gives no rows.
    """
    sets = distinct_sets(df, key, items, min_items)
    classes = set_classes(sets, key)
    members = cut_lineage(members_of(sets, classes, key))
    pairs = class_pairs(classes, n_sets, numerator, denominator, block)
    across = _records(pairs, "class_a", "copies_a", members, key, "x", block)
    across = _records(across, "class_b", "copies_b", members, key, "y", block).select("x", "y")
    mine = members.where("n_copies > 1").select("class_id", F.col(key).alias("r"), "n_copies")
    within = _met(mine, "class_id", "n_copies", "r", block).select(F.col("r_a").alias("x"), F.col("r_b").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def similar_between(
    left: DataFrame, right: DataFrame, key: str, items: str, min_items: int, numerator: int, denominator: int, n_sets: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """(<key>_left, <key>_right): all pairs of a record of one table and a record of another at or above the threshold.

    ``key`` is unique in each table and of one type in both; else as ``similar_pairs``. ``n_sets`` is the number of
    records of both tables.
    """
    sides = [distinct_sets(t, key, items, min_items).select(F.struct(F.lit(i).alias("side"), key).alias("_record"), "ids") for i, t in enumerate((left, right))]
    sets = sides[0].unionByName(sides[1])
    classes = set_classes(sets, "_record")
    members = cut_lineage(members_of(sets, classes, "_record")).withColumn("_side", F.col("_record")["side"])
    # A class meets itself, too: its records of either table are as good as equal.
    equal = classes.where("n_copies > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.col("n_copies").alias("copies_a"), F.col("n_copies").alias("copies_b"))
    pairs = class_pairs(classes, n_sets, numerator, denominator, block)
    turned = pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), F.col("copies_b").alias("copies_a"), F.col("copies_a").alias("copies_b"))
    out = _records(pairs.unionByName(turned).unionByName(equal), "class_a", "copies_a", members.where("_side = 0"), "_record", "x", block)
    out = _records(out, "class_b", "copies_b", members.where("_side = 1"), "_record", "y", block)
    return out.select(F.col("x")[key].alias(f"{key}_left"), F.col("y")[key].alias(f"{key}_right"))


def record_links(
    df: DataFrame, key: str, items: str, min_items: int, numerator: int, denominator: int, n_sets: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """One row per record in a class: key, class_id, n_copies (records with the same set), n_links (other records, of
    other classes, at or above the threshold). Linear in the records however many copies there are."""
    sets = distinct_sets(df, key, items, min_items)
    classes = set_classes(sets, key)
    pairs = class_pairs(classes, n_sets, numerator, denominator, block)
    both = pairs.select(F.col("class_a").alias("class_id"), F.col("copies_b").alias("n")).unionByName(
        pairs.select(F.col("class_b").alias("class_id"), F.col("copies_a").alias("n"))
    )
    links = both.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    linked = cut_lineage(_shuffled(classes, links, "class_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))))
    return members_of(sets, linked, key, "n_links")
