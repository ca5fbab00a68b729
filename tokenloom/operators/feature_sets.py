"""Sets of features per token, snippet or language, and how much they overlap."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.features import selected_features, snippet_column
from tokenloom.session import cut_lineage

#: Sets handled as one block of the product: at most so many, and fewer of few sets, so that there is work for all.
BLOCK_SETS = 2048
#: Features of a block's sets, on average at most. Fewer sets are a block where sets are large.
BLOCK_FEATURES = 1 << 21
#: Pairs of sets whose common features are counted at once in a task, entries that are met with each other at once, and
#: frequent features multiplied at once. They bound the memory of a task, whatever the sets have in common.
STRIP_PAIRS = 1 << 20
MEETS = 1 << 20
SLAB = 1024
#: Time to meet two entries, in multiplications of the product of frequent features.
MEET_COST = 1000


def feature_sets(df: DataFrame, by: Sequence[str], top_k: int = 5) -> DataFrame:
    """``by``, features: the sorted union of the first k features over the rows of each key. Null keys are keys; keys
    without any feature have an empty set."""
    long = df.select(*by, F.explode_outer(selected_features(df, top_k)).alias("f")).distinct()
    return long.groupBy(*by).agg(F.array_sort(F.collect_set("f")).alias("features"))


def token_feature_sets(df: DataFrame, top_k: int = 5, language_col: str = "language", token_col: str = "token_str", drop_empty_tokens: bool = False) -> DataFrame:
    for c in (language_col, token_col):
        if c not in df.columns:
            raise ValueError(f"missing column {c}")
    if drop_empty_tokens:
        df = df.where(F.coalesce(F.length(token_col), F.lit(0)) > 0)
    return feature_sets(df, [language_col, token_col], top_k)


def snippet_feature_sets(df: DataFrame, top_k: int = 5, snippet_id_col: str | None = None, language_col: str = "language") -> DataFrame:
    return feature_sets(df, [snippet_column(df, snippet_id_col), language_col], top_k)


def feature_indicators(df: DataFrame, top_k: int = 5, snippet_id_col: str | None = None, language_col: str = "language") -> DataFrame:
    """The long form of the binary snippet by feature matrix: distinct (snippet, language, feature_id). Snippets
    without features and rows with a null key are not in it."""
    unit = snippet_column(df, snippet_id_col)
    return (
        df.where(F.col(unit).isNotNull() & F.col(language_col).isNotNull())
        .select(unit, language_col, F.explode(selected_features(df, top_k)).alias("feature_id"))
        .distinct()
    )


class _Side(NamedTuple):
    """A block's sets by language: unit, language and size of each; its distinct features in order, the number of sets
    that have each, and these sets one feature after the other."""

    unit: np.ndarray
    language: np.ndarray
    sizes: np.ndarray
    features: np.ndarray
    counts: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(sets: pa.Table) -> _Side:
        sets = sets.select(["unit", "language", "features"]).sort_by("language").combine_chunks()
        plain = lambda name: sets.column(name).to_numpy()
        lists = sets.column("features").combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        entries = lists.flatten().to_numpy(zero_copy_only=False)
        features, counts = np.unique(entries, return_counts=True)
        narrow = np.uint16 if len(sizes) <= 1 << 16 else np.uint32
        owners = np.repeat(np.arange(len(sizes), dtype=narrow), sizes)[np.argsort(entries, kind="stable")]
        return _Side(plain("unit"), plain("language"), sizes.astype(np.int32), features.astype(np.int64), counts.astype(np.int32), owners)

    def packed(self) -> list[pa.Array]:
        texts = [pa.array([list(x)], pa.list_(pa.string())) for x in (self.unit, self.language)]
        return texts + [pa.array([x.tobytes()], pa.binary()) for x in (self.sizes, self.features, self.counts, self.owners)]

    @staticmethod
    def unpacked(row: dict) -> _Side:
        narrow = np.uint16 if len(row["unit"]) <= 1 << 16 else np.uint32
        kinds = (("sizes", np.int32), ("features", np.int64), ("counts", np.int32), ("owners", narrow))
        return _Side(*(np.array(row[c], object) for c in ("unit", "language")), *(np.frombuffer(row[c], kind) for c, kind in kinds))


_PACKED = "unit array<string>, language array<string>, sizes binary, features binary, counts binary, owners binary"


class _Entries(NamedTuple):
    """A side's entries of the features that both sides have: feature, by its number, and set of each, by feature;
    number and first of the entries of each feature."""

    feature: np.ndarray
    owner: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(side: _Side, common: np.ndarray) -> _Entries:
        counts = side.counts[common].astype(np.int64)
        at = _ranges((np.cumsum(side.counts, dtype=np.int64) - side.counts)[common], counts)
        return _Entries(np.repeat(np.arange(len(common), dtype=np.int32), counts), side.owners[at].astype(np.int32), counts, np.cumsum(counts) - counts)


def _ranges(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``times`` numbers from each of ``first`` on, one range after the other."""
    return np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())


def _shared(a: _Entries, b: _Entries, begin: int, n: int, m: int) -> np.ndarray:
    """Number of features that each of the n sets of ``a`` from ``begin`` on shares with each of the m sets of ``b``.
    Those of frequent features are a product of matrices, slab by slab; entries of rare ones are met with each other."""
    out = np.zeros((n, m))
    own = (a.owner >= begin) & (a.owner < begin + n)
    feature, owner = a.feature[own], a.owner[own] - begin
    frequent = np.bincount(feature, minlength=len(a.counts)) * b.counts * MEET_COST > n * m
    number = np.cumsum(frequent) - 1

    def matrix(features: np.ndarray, owners: np.ndarray, rows: int, k: int) -> np.ndarray:
        i, j = np.searchsorted(features, [k, k + SLAB])
        cells = np.zeros((rows, SLAB), np.float32)
        cells[owners[i:j], features[i:j] - k] = 1
        return cells

    x, y = frequent[feature], frequent[b.feature]
    left, right = (number[feature[x]], owner[x]), (number[b.feature[y]], b.owner[y])
    for k in range(0, int(frequent.sum()), SLAB):
        out += matrix(*left, n, k) @ matrix(*right, m, k).T

    feature, owner, cells = feature[~x], owner[~x].astype(np.int64), out.ravel()
    times, first = b.counts[feature], b.first[feature]
    ends = np.cumsum(times)
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + MEETS, "right")))
        codes = np.repeat(owner[i:j] * m, times[i:j]) + b.owner[_ranges(first[i:j], times[i:j])]
        np.add.at(cells, codes, 1.0)
        i = j
    return out


def _tile(a: _Side, b: _Side, same: bool, mode: str) -> list[tuple[str, str, float, int]]:
    """Sums of Jaccard similarities and pair counts per pair of languages, over one tile of the product; of a block with
    itself each unordered pair once."""
    n, m = len(a.sizes), len(b.sizes)
    _, *common = np.intersect1d(a.features, b.features, assume_unique=True, return_indices=True)
    left, right = (_Entries.of(side, at) for side, at in zip((a, b), common, strict=True))
    (first_a, of_a), (first_b, of_b) = _runs(a.language), _runs(b.language)
    x, y = _equal_units(a.unit, b.unit) if mode == "other_snippets" else (np.zeros(0, np.int64),) * 2
    if same:
        x, y = x[x < y], y[x < y]
    counts = np.outer(np.bincount(of_a), np.bincount(of_b))
    if same:
        alone = np.bincount(of_a)
        counts = np.triu(counts, 1) + np.diag(alone * (alone - 1) // 2)
    np.subtract.at(counts, (of_a[x], of_b[y]), 1)
    sums = np.zeros(counts.shape)
    strip = max(1, STRIP_PAIRS // max(1, m))
    for begin in range(0, n, strip):
        rows = min(strip, n - begin)
        similar = _shared(left, right, begin, rows, m)
        union = a.sizes[begin : begin + rows, None] + b.sizes - similar
        np.divide(similar, union, out=similar, where=union > 0)
        here = (x >= begin) & (x < begin + rows)
        similar[x[here] - begin, y[here]] = 0
        if same:
            similar = np.triu(similar, begin + 1)
        np.add.at(sums, of_a[begin : begin + rows], np.add.reduceat(similar, first_b, axis=1))
    return [(a.language[i], b.language[j], float(sums[p, q]), int(counts[p, q])) for p, i in enumerate(first_a) for q, j in enumerate(first_b)]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of equal values, and the number of each value's run."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _equal_units(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets of equal units. A unit has one set per language, so few share one."""
    codes: dict[str, int] = {}
    left, right = (np.array([codes.setdefault(u, len(codes)) for u in side], np.int64) for side in (a, b))
    order = np.argsort(right, kind="stable")
    first, last = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    return np.repeat(np.arange(len(left)), last - first), order[_ranges(first, last - first)]


def block_count(n_sets: int, n_features: int, block: int | None = None) -> int:
    """Number of blocks of so many sets with so many features in all: by sets (``block`` in each) and by features."""
    by_sets = -(-n_sets // (block or min(BLOCK_SETS, max(256, n_sets // 12))))
    return max(1, by_sets, min(n_sets, -(-n_features // BLOCK_FEATURES)))


def overlap_matrix(sets: DataFrame, unit: str, language: str = "language", mode: str = "other_snippets", block: int | None = None) -> DataFrame:
    """(language_1, language_2, mean_jaccard, n_pairs): mean Jaccard similarity over the pairs of sets of two languages.

    ``mode``: ``other_snippets`` leaves out pairs of the same unit, across languages too; ``all`` only a set with
    itself. Sets that share nothing count as 0, empty ones too. A block without a valid pair is NaN. Null languages are
    left out; a unit has one set per language.

    Sets are cut into blocks of bounded size, and a task settles all pairs of two blocks: no pair becomes a row, and a frequent feature
    is as many tasks' work as there are blocks. Each block is sent once for each block that it meets, with each feature
    once and two bytes for each set that has it.
    """
    rows = cut_lineage(sets.where(F.col(language).isNotNull()).select(F.col(unit).cast("string").alias("unit"), F.col(language).cast("string").alias("language"), F.col("features").cast("array<bigint>").alias("features")))
    n_sets, n_features = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.size("features"), F.lit(0))), F.lit(0))).first()
    n_blocks = block_count(n_sets, n_features, block)
    where = F.pmod(F.xxhash64("unit", "language"), F.lit(n_blocks))

    def pack(sets: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([sets.column("own").slice(0, 1).combine_chunks(), *_Side.of(sets).packed()], names=["own", *_Side._fields])

    blocks = rows.withColumn("own", where).groupBy("own").applyInArrow(pack, f"own bigint, {_PACKED}")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("other")
    meeting = blocks.select("*", other).select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", *_Side._fields)
    # A tile is much work and few bytes: tasks follow the number of tiles.
    tasks = min(10_000, n_blocks * (n_blocks + 1) // 2)

    def run(met: pa.Table) -> pa.Table:
        sides = {row["own"]: _Side.unpacked(row) for row in met.to_pylist()}
        x, y = met.column("a")[0].as_py(), met.column("b")[0].as_py()
        t = _tile(sides[x], sides[y], x == y, mode) if {x, y} == {*sides} else []  # a block without sets has no row
        return pa.Table.from_arrays(
            [pa.array([r[k] for r in t], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))],
            names=["x", "y", "total", "n"],
        )

    tiles = meeting.repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(run, "x string, y string, total double, n bigint")
    one_way = tiles.groupBy(F.least("x", "y").alias("language_1"), F.greatest("x", "y").alias("language_2")).agg(F.sum("total").alias("total"), F.sum("n").alias("n_pairs"))
    means = one_way.withColumn("mean_jaccard", F.when(F.col("n_pairs") > 0, F.col("total") / F.col("n_pairs")).otherwise(F.lit(float("nan")))).drop("total")
    both = F.explode(F.array(F.struct(F.col("language_1").alias("p"), F.col("language_2").alias("q")), F.struct(F.col("language_2").alias("p"), F.col("language_1").alias("q"))))
    return means.withColumn("_pair", both).select(F.col("_pair.p").alias("language_1"), F.col("_pair.q").alias("language_2"), "mean_jaccard", "n_pairs").distinct()


def mean_jaccard(left: Sequence[Sequence[int]], right: Sequence[Sequence[int]], same: bool = False) -> float:
    """Mean Jaccard similarity of two given lists of feature sets: every pair of one of each, or, with ``same``, every
    unordered pair of the first list. Two empty sets have similarity 0; no pair gives NaN. For lists that fit a driver."""
    sides = [[sorted({x for x in s if x is not None}) for s in side] for side in ((left, left) if same else (left, right))]
    a, b = (_Side.of(pa.table({"unit": [""] * len(side), "language": [""] * len(side), "features": pa.array(side, pa.list_(pa.int64()))})) for side in sides)
    if not len(a.unit) or not len(b.unit):
        return float("nan")
    total, n = (sum(t[k] for t in _tile(a, b, same, "all")) for k in (2, 3))
    return total / n if n else float("nan")


def concept_overlap(df: DataFrame, top_k: int = 5, snippet_id_col: str | None = None, exclude_same_snippet_id_pairs: bool = True) -> DataFrame:
    """Overlap of snippets' features by language. Snippets without features are not in it."""
    unit = snippet_column(df, snippet_id_col)
    sets = feature_indicators(df, top_k, unit).groupBy(unit, "language").agg(F.collect_set("feature_id").alias("features"))
    return overlap_matrix(sets, unit, mode="other_snippets" if exclude_same_snippet_id_pairs else "all")


def concept_overlap_tokens(df: DataFrame, top_k: int = 5, token_col: str = "token_str") -> DataFrame:
    """Overlap of tokens' features by language: within a language each pair of tokens once, across languages all.
    Tokens without features count, with similarity 0."""
    return overlap_matrix(token_feature_sets(df, top_k, token_col=token_col), token_col, mode="all")
