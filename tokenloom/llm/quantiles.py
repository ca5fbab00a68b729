"""Percentiles of large numeric columns by compressed dyadic-tree counts (quantile digests).

A value is mapped, in order, to an integer of ``UNIVERSE_BITS`` bits. A digest is a set of nodes (level, prefix, count)
of the binary tree over that universe: level 0 are single integers, a node at level j covers 2**j of them. Compression
moves the counts of small siblings to their parent; what it costs is rank error of at most UNIVERSE_BITS * n / factor.
Two digests merge by adding the counts of equal nodes, so tasks, days and batches combine in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the ordered universe: sign, exponent and the first 15 bits of the fraction of a 32-bit float.
UNIVERSE_BITS = 24
#: Compression factor: the rank error is at most UNIVERSE_BITS / FACTOR of the count, 0.5 %; a digest has at most
#: 3 * FACTOR nodes.
FACTOR = 4800
RANK_ERROR = UNIVERSE_BITS / FACTOR
#: Reported values lie nearer to zero than the true ones by at most this share, if those are normal 32-bit numbers;
#: integers up to 65,536 are exact. Larger numbers come out as infinity or the greatest 32-bit one, smaller ones lose
#: digits. Ranks are not touched by that.
VALUE_ERROR = 2.0**-15
#: Values held in a task before they are made a digest.
HELD_VALUES = 1_000_000
#: Levels of the part of a tree that merged nodes are compressed in at a time: at most 2**19 nodes.
PART_LEVELS = 18


def to_universe(values: np.ndarray) -> np.ndarray:
    """Order-preserving map of finite or infinite numbers to 0 .. 2**UNIVERSE_BITS - 1."""
    x = np.asarray(values, np.float64)
    with np.errstate(over="ignore"):
        near = x.astype(np.float32)
    # Rounding to 32 bits may go up; step back, so that the map never passes the value.
    above = near.astype(np.float64) > x
    near = np.where(above, np.nextafter(near, np.float32(-np.inf), dtype=np.float32), near) + np.float32(0.0)
    bits = near.view(np.uint32).astype(np.int64)
    ordered = np.where(bits >> 31, 0xFFFFFFFF - bits, bits | 0x80000000)
    return ordered >> (32 - UNIVERSE_BITS)


def from_universe(codes: np.ndarray) -> np.ndarray:
    """The least magnitude-side edge of a code's range: the lower edge for positive values."""
    ordered = np.asarray(codes, np.int64) << (32 - UNIVERSE_BITS)
    bits = np.where(ordered >> 31, ordered & 0x7FFFFFFF, 0xFFFFFFFF - ordered)
    return bits.astype(np.uint32).view(np.float32).astype(np.float64)


def compress(
    level: np.ndarray, prefix: np.ndarray, count: np.ndarray, factor: int = FACTOR, top: int = UNIVERSE_BITS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Move the counts of sibling nodes, whose sum with their parent's is at most n / factor, to the parent, level by
    level up to ``top``."""
    n = int(count.sum())
    limit = n // factor
    out = []
    carry_p, carry_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for j in range(top + 1):
        own = level == j
        p, c = np.r_[prefix[own], carry_p], np.r_[count[own], carry_c]
        if len(p):
            p, inverse = np.unique(p, return_inverse=True)
            c = np.bincount(inverse, c, len(p)).astype(np.int64)
        if j == top or not limit:
            out.append((np.full(len(p), j), p, c))
            carry_p, carry_c = np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        parents, inverse = np.unique(p >> 1, return_inverse=True)
        both = np.bincount(inverse, c, len(parents)).astype(np.int64)
        above_own = level == j + 1
        if above_own.any() and len(parents):
            at = np.searchsorted(parents, prefix[above_own])
            hit = (at < len(parents)) & (parents[np.minimum(at, len(parents) - 1)] == prefix[above_own])
            total = both.copy()
            np.add.at(total, at[hit], count[above_own][hit])
        else:
            total = both
        up = total <= limit
        stay = ~up[inverse] if len(p) else np.empty(0, bool)
        out.append((np.full(int(stay.sum()), j), p[stay], c[stay]))
        carry_p, carry_c = parents[up], both[up]
    return tuple(np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3))


def digest(df: DataFrame, groups: Sequence[str], values: Sequence[str], factor: int = FACTOR) -> DataFrame:
    """The digests of the columns ``values`` per group, as a table of nodes: groups, metric, level, prefix, n.

    Null and NaN values are left out; infinite ones count. Null groups are groups of their own. A task makes a digest of
    every HELD_VALUES values, so what it holds is bounded, and a group sends at most 3 * factor nodes of each, whatever
    its size. The digests are then merged. The result can be stored and merged with those of other batches (``merge``).
    """
    groups = list(groups)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    long = df.select(*groups, pairs.alias("p")).select(*groups, "p.metric", "p.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    names = [*groups, "metric"]
    shape = _shape(df, groups)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            codes = to_universe(batch.column(len(names)).to_numpy(zero_copy_only=False))
            held.append(pa.Table.from_batches([batch]).select(names).append_column("code", pa.array(codes)))
            size += batch.num_rows
            if size >= HELD_VALUES:
                yield from _digests(held, names, shape, factor)
                held, size = [], 0
        if held:
            yield from _digests(held, names, shape, factor)

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "metric string, level int, prefix bigint, n bigint"])
    return merge(long.mapInArrow(local, schema), groups, factor)


def _shape(df: DataFrame, groups: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    nodes = df.select(*groups, F.lit("").alias("metric"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("n"))
    return to_arrow_schema(nodes.schema)


def _digests(held: list[pa.Table], names: list[str], shape: pa.Schema, factor: int) -> Iterator[pa.RecordBatch]:
    """The digest of each group among some values."""
    counted = pa.concat_tables(held).group_by([*names, "code"], use_threads=False).aggregate([([], "count_all")])
    number = np.zeros(counted.num_rows, np.int64)  # of the group, column by column
    for name in names:
        column = counted.column(name).combine_chunks().dictionary_encode()
        own = column.indices.fill_null(len(column.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (len(column.dictionary) + 1) + own, return_inverse=True)[1]
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    order = np.argsort(number, kind="stable")
    codes, n = (counted.column(c).to_numpy()[order].astype(np.int64) for c in ("code", "count_all"))
    ends = np.searchsorted(number[order], np.arange(len(first) + 1))
    parts, owner = [], []
    for g in range(len(first)):
        own = slice(ends[g], ends[g + 1])
        nodes = compress(np.zeros(ends[g + 1] - ends[g], np.int64), codes[own], n[own], factor)
        parts.append(nodes)
        owner.append(np.full(len(nodes[0]), first[g], np.int64))
    if parts:
        level, prefix, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        columns = [counted.column(c).combine_chunks().take(pa.array(np.concatenate(owner))).cast(shape.field(c).type) for c in names]
        yield from pa.Table.from_arrays([*columns, pa.array(level.astype(np.int32)), pa.array(prefix), pa.array(count)], schema=shape).to_batches(max_chunksize=50_000)


def merge(nodes: DataFrame, groups: Sequence[str], factor: int = FACTOR) -> DataFrame:
    """The digests of tasks, days or batches (union their tables first) as one: counts of equal nodes are added up, then
    compressed again, so that a digest does not grow with what it is merged from.

    Trees are compressed in parts of PART_LEVELS levels, a part by itself, so a large group is many tasks' work. A node
    of a part holds at most the part's count / factor, which is less than n / factor: the rank error of the whole stays
    the same. A group has at most 2**(UNIVERSE_BITS - PART_LEVELS) * 3 * factor nodes, and hardly ever that many.
    """
    groups = list(groups)
    part = F.when(F.col("level") > PART_LEVELS, F.lit(-1)).otherwise(F.expr(f"shiftright(prefix, {PART_LEVELS} - level)"))
    keys = [*groups, "metric", "_part"]
    shape = _shape(nodes, groups)

    def again(own: pa.Table) -> pa.Table:
        if own.column("_part")[0].as_py() < 0:
            return own.select(shape.names)
        level, prefix, n = (own.column(c).to_numpy().astype(np.int64) for c in ("level", "prefix", "n"))
        level, prefix, n = compress(level, prefix, n, factor, PART_LEVELS)
        first = own.select([*groups, "metric"]).take([0] * len(n))
        return pa.Table.from_arrays([*first.columns, pa.array(level.astype(np.int32)), pa.array(prefix), pa.array(n)], names=shape.names).cast(shape)

    added = nodes.withColumn("_part", part).repartition(*keys).groupBy(*keys, "level", "prefix").agg(F.sum("n").alias("n"))
    return added.groupBy(*keys).applyInArrow(again, nodes.select(*groups, "metric", "level", "prefix", "n").schema)


def read_percentiles(nodes: DataFrame, groups: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """groups, metric, n, percentile, value: the value at each share of a digest's count.

    The rank of ``value`` lies within RANK_ERROR * n of share * n. ``nodes`` are those of ``merge``, so a group has some
    ten thousand, however much data it is of.
    """
    groups = list(groups)
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}

    def read(own: pd.DataFrame) -> pd.DataFrame:
        level, prefix, n = (own[c].to_numpy(np.int64) for c in ("level", "prefix", "n"))
        high = ((prefix + 1) << level) - 1  # post-order: by upper end, small nodes first
        order = np.lexsort((level, high))
        total = n.sum()
        running = np.cumsum(n[order])
        at = np.searchsorted(running, np.maximum(1, np.ceil(np.asarray(shares) * total)))
        out = pd.DataFrame({"n": total, "percentile": list(shares), "value": from_universe(high[order][np.minimum(at, len(order) - 1)])})
        for g in [*groups, "metric"]:
            first = own[g].iloc[0]
            out[g] = None if pd.isna(first) else first
        return out[[*groups, "metric", "n", "percentile", "value"]]

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in groups), "metric string, n bigint, percentile double, value double"])
    return nodes.groupBy(*groups, "metric").applyInPandas(read, schema)


def rank_check(df: DataFrame, groups: Sequence[str], values: Sequence[str], percentiles: DataFrame, salts: int = 16) -> DataFrame:
    """``percentiles`` with least_rank and greatest_rank, the exact ranks of the values that a reported one stands for,
    and within: share * n lies no further from them than RANK_ERROR * n, and n is exact.

    Values that are not negative. They are counted in place; the few percentiles go to the counts of each group, of
    which there are ``salts`` parts.
    """
    groups = list(groups)
    keys = [*groups, "metric"]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    counts = (
        df.select(*groups, pairs.alias("p"))
        .select(*groups, "p.metric", "p.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("k"))
        .withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int"))
    )
    asked = percentiles.select(*[F.col(c).alias(f"_{c}") for c in keys], F.struct("percentile", F.col("value").alias("v"), F.col("n").alias("told")).alias("p"))
    asked = asked.groupBy(*[f"_{c}" for c in keys]).agg(F.collect_list("p").alias("ps")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.col("_salt") == F.col("_part")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    x, v = F.col("value"), F.col("p.v")
    met = counts.hint("merge").join(asked.hint("merge"), same).select(*keys, "value", "k", F.explode("ps").alias("p"))
    ranked = met.groupBy(*keys, "p.percentile", "p.told").agg(
        F.sum("k").alias("n"),
        F.sum(F.when(x < v, F.col("k")).otherwise(0)).alias("least_rank"),
        F.sum(F.when(x <= v * (1 + 2 * VALUE_ERROR), F.col("k")).otherwise(0)).alias("greatest_rank"),
    )
    place, allowed = F.col("percentile") * F.col("n"), F.col("n") * RANK_ERROR + 1
    within = (F.col("least_rank") - allowed <= place) & (place <= F.col("greatest_rank") + allowed) & (F.col("n") == F.col("told"))
    return ranked.withColumn("within", within)
