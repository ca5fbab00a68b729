"""Operators on tokens in their order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.session import cut_lineage


def add_neighbor_tokens(
    df: DataFrame,
    relative_positions: Sequence[int] = (-2, -1, 1, 2),
    col: str = "token_str",
    keys: Sequence[str] = ("global_idx", "language"),
    position: str = "token_pos",
) -> DataFrame:
    """Adds ``previous_<col>_n`` and ``next_<col>_n``: the value n rows before or after in the same sequence.

    Rows count, not position values, so gaps don't matter; of rows with the same position the least value stands for
    the position, and all of them get its neighbours. 0 gives the value itself. Null keys are a sequence of their own.
    """
    keys = list(keys)
    # One exchange by sequence: the rows of a position are numbered, and its neighbours are looked for by position.
    same = Window.partitionBy(*keys, position).orderBy(F.col(col).asc_nulls_last())
    by_position = Window.partitionBy(*keys).orderBy(F.col(position).asc_nulls_first())
    rows = df.repartition(*keys).withColumn("_first", F.row_number().over(same) == 1).withColumn("_place", F.dense_rank().over(by_position))
    shift = lambda n: Window.partitionBy(*keys).orderBy("_place").rangeBetween(n, n)
    value = F.when(F.col("_first"), F.struct(F.col(col).alias("v")))  # a struct, since the value may be null
    for n in relative_positions:
        name = f"previous_{col}_{-n}" if n < 0 else f"next_{col}_{n}"
        rows = rows.withColumn(name, F.first(value, ignorenulls=True).over(shift(n))["v"])
    return rows.drop("_first", "_place")


def previous_and_next(df: DataFrame, keys: Sequence[str], position: Sequence[str], col: str = "token_str") -> DataFrame:
    """Adds prev_<col> and next_<col> of the row before and after in each sequence."""
    order = Window.partitionBy(*keys).orderBy(*position)
    return df.withColumn(f"prev_{col}", F.lag(col).over(order)).withColumn(f"next_{col}", F.lead(col).over(order))


def last_write_before(df: DataFrame, sequence: Sequence[str], key: Column | str, order: Sequence[str], is_write: Column, value: Column) -> Column:
    """``value`` of the last row before this one, in its sequence and of the same key, where ``is_write`` holds."""
    frame = Window.partitionBy(*sequence, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(is_write, value), ignorenulls=True).over(frame)


def _in_parts(df: DataFrame, major: str, minor: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): ``df`` sorted by (``major``, ``minor``) over all tasks, with _p, its part, and _run, the sum of
    ``value`` from the first row of its major in its part on; and _p, major, _sum of each part and major in it, which
    number no more than parts and majors together."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField("_p", T.IntegerType()), T.StructField("_run", T.LongType())])
    shape = to_arrow_schema(schema)
    majors, values = df.columns.index(major), df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, total = object(), 0
        for batch in batches:
            sums = []
            for m, v in zip(batch.column(majors).to_pylist(), batch.column(values).to_pylist()):
                total = (total if m == last else 0) + (v or 0)
                last = m
                sums.append(total)
            added = [pa.array([part] * len(sums), pa.int32()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(c.cast(shape.field(i).type) for i, c in enumerate(batch.columns)), *added], schema=shape)

    rows = cut_lineage(df.orderBy(major, minor).mapInArrow(run, schema))
    return rows, rows.groupBy("_p", major).agg(F.sum(value).alias("_sum"))


def _with_base(rows: DataFrame, parts: DataFrame, major: str, before: Column) -> DataFrame:
    """``rows`` with _base, ``before`` of their part and major. No key is more than a part."""
    base = parts.select(F.col("_p").alias("_q"), F.col(major).alias("_major"), F.coalesce(before, F.lit(0)).alias("_base"))
    same = (F.col("_p") == F.col("_q")) & F.col(major).eqNullSafe(F.col("_major"))
    return rows.hint("merge").join(base.hint("merge"), same).drop("_q", "_major")


def running_total(df: DataFrame, major: str, minor: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one, ordered by (``major``, ``minor``).

    ``minor`` is unique, as a hash is (``spread_key``); a null ``value`` adds nothing. Rows are sorted over all tasks
    and added up part by part; only the sums of the parts, one row for each part and each major, meet in one window.
    """
    rows, parts = _in_parts(df, major, minor, value)
    ahead = Window.orderBy(major, "_p").rowsBetween(Window.unboundedPreceding, -1)
    return _with_base(rows, parts, major, F.sum("_sum").over(ahead)).withColumn(name, F.col("_base") + F.col("_run")).drop("_p", "_run", "_base")


def place_within(df: DataFrame, major: str, minor: str, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within each ``major`` in order of ``minor``, which is unique. A major of any size is
    numbered by many tasks."""
    rows, parts = _in_parts(df.withColumn("_one", F.lit(1)), major, minor, "_one")
    ahead = Window.partitionBy(major).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return _with_base(rows, parts, major, F.sum("_sum").over(ahead)).withColumn(name, F.col("_base") + F.col("_run")).drop("_p", "_run", "_base", "_one")


def spread_key(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 2**60 by which rows come in random but fixed order: 15 hex digits of the digest of seed and
    key. The same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def token_budget(
    samples: DataFrame,
    source_order: str,
    sample_id: str,
    tokens: str,
    target: int,
    max_per_source: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """Samples in order of their source, shuffled within it, until the running token count reaches ``target``.

    At most ``max_per_source`` samples of a source count; the sample that crosses the target is kept; a target of zero
    or less means no limit. The shuffle is a hash of seed and id, so the choice is the same on every run.
    """
    rows = place_within(samples.withColumn("_h", spread_key(F.col(sample_id), seed)), source_order, "_h", "_place")
    capped = rows.where(F.col("_place") <= max_per_source).drop("_place")
    out = running_total(capped, source_order, "_h", tokens, "running_tokens")
    if target > 0:
        out = out.where(F.col("running_tokens") - F.col(tokens) < target)
    return out.drop("_h")


def skip_and_limit(df: DataFrame, order: Sequence[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in total order; a limit of 0 gives none. Rows are numbered where they are, so
    those skipped don't pass through one task."""
    from tokenloom.operators.tokens import number_rows

    if limit == 0:
        return df.limit(0)
    numbered = number_rows(df, list(order), "_number").where(F.col("_number") >= skip)
    if limit is not None:
        numbered = numbered.where(F.col("_number") < skip + limit)
    return numbered.orderBy("_number").drop("_number")
