"""Pairs of items that appear together in a record, and how far that exceeds chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a basket beyond this make it a large basket, which is split into chunks of half this size.
LARGE_BASKET = 256
#: Pairs counted in a task before the counts are handed on.
HELD_PAIRS = 2_000_000


def baskets(df: DataFrame, items: str, record: list[str]) -> DataFrame:
    """(record..., items): each record once, its distinct non-null items in ascending order.

    Records whose list is null, empty or all null are left out. Of a record stored several times one copy counts:
    that with the greatest list, so that the result is the same whenever it is computed.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull())))
    return (
        df.select(*record, clean.alias("items"))
        .where(F.size("items") > 0)
        .groupBy(*record)
        .agg(F.max("items").alias("items"))
    )


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of item lists: all a < b within ``left`` where ``right`` is null, else left x right."""
    names = ["feature_a", "feature_b", "n_ab"]
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        low, high = (int(min(a.min(), b.min())), int(max(a.max(), b.max()))) if len(a) else (0, 0)
        if high - low < 1 << 31:  # both fit in one integer, which sorts faster
            order = np.argsort(key := (a - low) << np.int64(32) | (b - low), kind="stable")
            key = key[order]
            first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        else:
            order = np.lexsort((b, a))
            first = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
        at = np.flatnonzero(first)
        return a[order][at], b[order][at], np.add.reduceat(n[order], at) if len(at) else n

    def out(t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(t[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000]) for x in t], names=names)

    for batch in batches:
        left, right = batch.column(0), batch.column(1)
        ends = left.offsets.to_numpy()
        flat = left.values.to_numpy(zero_copy_only=False)
        plain = right.is_null().to_numpy(zero_copy_only=False)
        length = np.diff(ends)
        for n in np.unique(length[plain]):  # baskets of one size at a time
            if n < 2:
                continue
            rows = np.flatnonzero(plain & (length == n))
            i, j = np.triu_indices(int(n), 1)
            for k in range(0, len(rows), max(1, HELD_PAIRS // len(i))):
                block = flat[ends[rows[k : k + max(1, HELD_PAIRS // len(i))]][:, None] + np.arange(n)]
                a, b = block[:, i].ravel(), block[:, j].ravel()
                held.append((a, b, np.ones(len(a), np.int64)))
                size += len(a)
                if size >= HELD_PAIRS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield from out(held[0])
                        held, size = [], 0
        for row in np.flatnonzero(~plain):
            x, y = np.asarray(left[row].as_py(), np.int64), np.asarray(right[row].as_py(), np.int64)
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            held.append((a, b, np.ones(len(a), np.int64)))
            size += len(a)
            if size >= HELD_PAIRS:
                yield from out(merged())
                held, size = [], 0
    if held:
        yield from out(merged())


def chunk_rows(df: DataFrame, size: int) -> DataFrame:
    """(record, i, l, behind): each chunk of ``size`` items of each record with those behind it, in tasks by record and
    number. Chunks of sorted items are in ascending order, so left < right holds between chunks."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / size).cast("int")), lambda i: F.slice("items", i * size + 1, size))
    left = df.withColumn("chunks", chunks).select("record", "chunks", F.posexplode("chunks").alias("i", "l"))
    behind = F.slice("chunks", F.col("i") + 2, F.size("chunks"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, lest few bytes be made few tasks: they are much work
    return left.select("record", "i", "l", behind.alias("behind")).repartition(tasks, F.xxhash64("record", "i"))


def pair_counts(df: DataFrame, large: int = LARGE_BASKET) -> DataFrame:
    """(feature_a, feature_b, n_ab), feature_a < feature_b, from a table with a sorted list ``items`` per record and a
    number ``record``, which need not be unique.

    Large baskets are split into chunks. Each chunk is sent to a task by the numbers of its record and its own, and is
    multiplied there with itself and the chunks behind it; so neither a record nor copies of one make a task
    quadratically long. Ordinary baskets pass as they are. Tasks count their pairs before the shuffle; the counts of
    both kinds are then added up.
    """
    nothing = F.lit(None).cast("array<bigint>")
    plain = df.where(F.size("items").between(2, large)).select(F.col("items").alias("l"), nothing.alias("r"))
    spread = chunk_rows(df.where(F.size("items") > large), large // 2)
    cross = spread.select("l", F.explode(F.concat(F.array(nothing), "behind")).alias("r"))
    partial = plain.unionByName(cross).mapInArrow(_count_pairs, "feature_a bigint, feature_b bigint, n_ab bigint")
    return partial.groupBy("feature_a", "feature_b").agg(F.sum("n_ab").alias("n_ab"))


def associations(df: DataFrame, items: str, record: list[str], min_pairs: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items with their counts: feature_a, feature_b, n_ab, n_a, n_b, n, lift, pmi.

    n is the number of records with at least one item, n_a and n_b the records holding each item, n_ab those holding
    both; lift = n_ab * n / (n_a * n_b), pmi = log2(lift). Only pairs with n_ab >= ``min_pairs`` and lift >=
    ``min_lift`` (compared in exact decimals) come out. No records give no rows. Item counts are joined to the pairs
    that are left after the first condition; the exchange that makes records unique is shared by pairs and counts.
    """
    each = baskets(df, items, record).select(F.xxhash64(*record).alias("record"), "items")
    # The count of the null item added to each record is the number of records.
    with_total = F.concat("items", F.array(F.lit(None).cast("bigint")))
    counts = each.select(F.explode(with_total).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    total = counts.where(F.col("item").isNull()).select(F.col("n_item").alias("n"))
    known = counts.where(F.col("item").isNotNull())
    a = known.select(F.col("item").alias("feature_a"), F.col("n_item").alias("n_a"))
    b = known.select(F.col("item").alias("feature_b"), F.col("n_item").alias("n_b"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        pair_counts(each)
        .where(F.col("n_ab") >= min_pairs)
        .hint("merge")
        .join(a.hint("merge"), "feature_a")
        .join(b.hint("merge"), "feature_b")
        .crossJoin(F.broadcast(total))  # one row
        .where(exact("n_ab") * exact("n") >= exact("n_a") * exact("n_b") * F.lit(min_lift).cast("decimal(9,3)"))
        .select("feature_a", "feature_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
    )
