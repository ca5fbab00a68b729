"""Top N items within every group, by lower bounds from the partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.session import cut_lineage

#: Rows held back in a task before they are cut down to the N best of each group.
BUFFER_ROWS = 100_000
#: Rows kept in a task (many groups) before they are handed on.
KEPT_ROWS = 1_000_000
#: Bounds of so many groups are sent to all tasks; beyond, they are joined by a shuffle.
SENT_BOUNDS = 500_000


def _best(t: pa.Table, group: str, score: str, ties: Sequence[str], identity: Sequence[str], n: int) -> pa.Table:
    """The n best distinct items of each group in ``t``."""
    t = t.sort_by([(group, "ascending"), (score, "descending"), *[(c, "ascending") for c in ties]])
    if not t.num_rows:
        return t
    g = t.column(group).combine_chunks().to_numpy(zero_copy_only=False)
    first = np.r_[True, g[1:] != g[:-1]]
    same = ~first
    for c in identity:
        v = t.column(c).combine_chunks()
        both_null = pc.and_(pc.is_null(v[1:]), pc.is_null(v[:-1]))
        same[1:] &= pc.or_kleene(pc.equal(v[1:], v[:-1]), both_null).fill_null(False).to_numpy(zero_copy_only=False)
    fresh = ~same
    rank = np.cumsum(fresh)
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    rank = rank - rank[start] + 1
    return t.filter(pa.array(fresh & (rank <= n)))


def top_n_per_group(
    df: DataFrame, group: str, score: str, ties: Sequence[str], identity: Sequence[str], n: int
) -> DataFrame:
    """The ``n`` best items of each group: columns group, rank_no, score and ``ties``.

    Order: ``score`` descending, then ``ties`` ascending (strings by code point, nulls last). An item is what
    ``identity`` names (a subset of ``ties``) and counts once per group, however often it is stored. Rows with a null
    group, null or NaN score are left out; -0.0 equals 0.0; a group with fewer items gives those it has; an empty table
    gives no rows.

    Each task keeps the n best of each group of its own rows (nothing else of it can be among the n best of all), and
    reports the n-th best score as a lower bound. The greatest bound of each group is joined to what the tasks kept,
    rows below it fall out where they are, and only what is left, few more than n rows of a group however many tasks
    saw it, is exchanged and ranked.
    """
    columns = [group, score, *ties]
    slim = df.select(group, (F.col(score).cast("double") + F.lit(0.0)).alias(score), *ties).where(
        F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held, rows = None, [], 0

        def cut() -> pa.Table:
            fresh = pa.Table.from_batches(held)
            return _best(pa.concat_tables([kept, fresh]) if kept is not None else fresh, group, score, ties, identity, n)

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            g = t.column(group).combine_chunks().to_numpy(zero_copy_only=False)
            first = np.r_[True, g[1:] != g[:-1]]
            place = np.arange(len(g)) - np.maximum.accumulate(np.where(first, np.arange(len(g)), 0)) + 1
            scores = t.column(score).combine_chunks().to_numpy(zero_copy_only=False)
            bound = pa.array(np.where(place == n, scores, 0.0), mask=place != n)
            yield from t.append_column("_bound", bound).combine_chunks().to_batches(max_chunksize=20_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= max(BUFFER_ROWS, 0 if kept is None else kept.num_rows):  # what is kept is sorted again but a few times
                kept = cut()
                held, rows = [], 0
                if kept.num_rows >= KEPT_ROWS:  # any rows' own n best make valid bounds
                    yield from out(kept)
                    kept = None
        if held:
            kept = cut()
        if kept is not None and kept.num_rows:
            yield from out(kept)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)
    kept = cut_lineage(slim.select(*columns).mapInArrow(local, f"{schema}, _bound double"))
    bounds = kept.where(F.col("_bound").isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.max("_bound").alias("_least"))
    few = bounds.limit(SENT_BOUNDS + 1).count() <= SENT_BOUNDS
    rows = kept.drop("_bound")
    bounded = rows.join(F.broadcast(bounds), F.col(group) == F.col("_group"), "left") if few else rows.hint("merge").join(bounds.hint("merge"), F.col(group) == F.col("_group"), "left")
    passed = bounded.where(F.col("_least").isNull() | (F.col(score) >= F.col("_least"))).select(*columns)
    order = Window.partitionBy(group).orderBy(F.col(score).desc(), *[F.col(c).asc_nulls_last() for c in ties])
    tie_free = passed.withColumn("rank_no", F.dense_rank().over(order)).where(F.col("rank_no") <= n)
    return tie_free.dropDuplicates([group, *identity]).select(group, F.col("rank_no").cast("long").alias("rank_no"), score, *ties)
