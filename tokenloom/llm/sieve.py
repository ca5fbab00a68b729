"""Joins of two sides that both grow: a bitmap of fixed size drops most rows that have no partner before they are
exchanged, and rows of hot keys are spread over many tasks."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a place in a bitmap: 16 MB. However full it is, it only lets through more.
BITMAP_BITS = 27
#: Parts that the rows of a hot key are spread over.
SALTS = 64


def place_of(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - BITMAP_BITS)


def bitmap_of(hashes: DataFrame) -> Broadcast:
    """A bitmap of the leading bits of 64-bit hashes (the only column), for all tasks. It is put together by the
    executors in pieces of 4 kB, of which there are 2**BITMAP_BITS / 32,768 at most."""
    place = place_of(F.col(hashes.columns[0])) + 1  # buckets hold places from 1 on
    pieces = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    whole = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for b, bits in zip(pieces.column(0).to_pylist(), pieces.column(1).to_pylist()):
        whole[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole)


def hits(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which places (as ``place_of`` gives them) are set."""
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def hash_hits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes have their place set."""
    return hits(bitmap, (hashes >> np.uint64(65 - (len(bitmap) * 8).bit_length())).astype(np.int64))


def hot_rows(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold a thousandth of all grouped rows each (column n), so at most 1,000."""
    total = groups.agg(F.sum("n").alias("_all"))
    return groups.crossJoin(F.broadcast(total)).where(F.col("n") * 1000 >= F.col("_all")).select(*keys)  # one row


def salted_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: DataFrame, spread: str, how: str) -> DataFrame:
    """A shuffle join in which the rows of hot keys, known to be few keys, are spread by a salt of column ``spread``."""
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("_salt")
    left = rows.join(marks, keys, "left").select(*rows.columns, salt)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = side.join(marks, keys, "left").select(*side.columns, F.explode(salts).alias("_salt"))
    return left.hint("merge").join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
