"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

A gear hash runs over the code points; it depends on the last ``GEAR`` of them. A place is a cut if its hash is the
least of some ``CUT_WINDOW`` places in a row. Cuts therefore depend on nearby text only, come at least every CUT_WINDOW
places, and move along with the text when something is inserted before it. The chunk between two cuts, widened by a
fixed margin on both sides, is what digests are taken of. The numbers are chosen so that any ``span`` characters in a
row hold at least one widened chunk whose cuts are fixed by those characters alone: two texts that share a span share
a chunk, without exception.

Digests of chunks are counted, and those of several documents are marked in a bitmap of fixed size that goes to all
tasks. A second pass over the texts takes the chunks that hit it; what hits it by chance is sorted out exactly, later.
Spans are settled on digests of exactly ``span`` characters: first of those that begin or end at such a chunk, which
settles nearly all long copies, then of every place of what is left. All digests are grouped with least and greatest
document only, so a group of copies of any size stays one row.

How much of a document is shared is settled chunk by chunk: a chunk whose whole context (all spans that hold it) stands
in another document needs no closer look; of the others every span is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.sieve import bitmap_of, hash_hits, hits, hot_rows, place_of, salted_join
from tokenloom.session import cut_lineage

SPAN = 200
#: Characters that a gear hash covers: 64 bits, shifted by 4 for each.
GEAR = 16
#: Code points handled at once in a task.
BLOCK_CHARS = 1_000_000


def cut_window(span: int) -> int:
    """The widest window that leaves two cuts, fixed by the span alone, in every span."""
    w = (span - GEAR + 3) // 4
    if w < 4:
        raise ValueError("spans of fewer than 32 characters hold no full chunk")
    return w


_RNG = np.random.default_rng(7_919)
_TABLE_BITS = 16
_GEAR_TABLE = _RNG.integers(0, 2**63, 1 << _TABLE_BITS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xC2B2AE3D27D4EB4F | 5)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 2**64))
        self.base, self.inverse, self.up, self.down = base, inverse, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse)], dtype=np.uint64)
        return self.up, self.down


_POWERS: list[_Powers] = []


class Block:
    """Code points of several texts one after another, with prefix sums from which any slice's digest follows."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.points, self.starts, self.ends = points, starts, ends
        if not _POWERS:
            _POWERS.extend(_Powers(b) for b in _BASES)
        self._sums: list[np.ndarray | None] = [None, None]

    def digest(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """A 64-bit digest of each slice [begin, end), as int64."""
        up, down = _POWERS[which].get(len(self.points) + 1)
        if self._sums[which] is None:
            salt = np.uint64(0x51_7C_C1_B7 + 2 * which)
            self._sums[which] = np.r_[np.uint64(0), np.cumsum(_mix(self.points.astype(np.uint64) + salt) * up[: len(self.points)], dtype=np.uint64)]
        s = self._sums[which]
        return _mix((s[end] - s[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)

    def cuts(self, window: int) -> np.ndarray:
        """Places whose gear hash is the least of some ``window`` hashes in a row."""
        h = _GEAR_TABLE[(self.points & ((1 << _TABLE_BITS) - 1)) ^ (self.points >> _TABLE_BITS)]
        step, shift = 1, 4
        while step < GEAR:
            h[step:] += h[:-step] << np.uint64(shift)  # numpy buffers overlapping operands
            step, shift = 2 * step, 2 * shift
        h = _mix(h)
        n = len(h)
        if n < window:
            return np.empty(0, np.int64)
        low = _slide(h, window, np.minimum)  # low[i]: least of h[i : i + window]
        edge = np.zeros(window - 1, np.uint64)
        best = _slide(np.r_[edge, low, edge], window, np.maximum)  # greatest of the lows of windows with place i
        return np.flatnonzero(h == best[:n])


def _slide(x: np.ndarray, window: int, f: Callable) -> np.ndarray:
    """f over every ``window`` values in a row, by doubling."""
    have = 1
    while have * 2 <= window:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    rest = window - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _blocks(batches: Iterator[pa.RecordBatch], margin: int, extra: int = 0) -> Iterator[tuple[Block, np.ndarray, list, np.ndarray]]:
    """(block, core ranges, per piece its batch values, offset in its text). A text longer than a block is handled in
    pieces that overlap by ``margin`` on both sides; core ranges of pieces don't overlap."""
    points: list[np.ndarray] = []
    core: list[tuple[int, int]] = []
    bounds: list[tuple[int, int]] = []
    values: list[tuple] = []
    offset: list[int] = []
    size = 0

    def pack():
        b = np.array(bounds, np.int64).reshape(-1, 2)
        return Block(np.concatenate(points), b[:, 0], b[:, 1]), np.array(core, np.int64).reshape(-1, 2), values, np.array(offset, np.int64)

    for batch in batches:
        rest = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 1]
        for row, text in enumerate(batch.column(1)):
            text = text.as_py()
            if not text:
                continue
            whole = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            for at in range(0, len(whole), BLOCK_CHARS):
                begin, end = max(0, at - margin), min(len(whole), at + BLOCK_CHARS + margin)
                points.append(whole[begin:end])
                bounds.append((size, size + end - begin))
                core.append((size + at - begin, size + min(at + BLOCK_CHARS, len(whole)) - begin))
                values.append(tuple(r[row] for r in rest))
                offset.append(begin - size)
                size += end - begin
                if size >= BLOCK_CHARS:
                    yield pack()
                    points, core, bounds, values, offset, size = [], [], [], [], [], 0
    if points:
        yield pack()


def _chunks(block: Block, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece) of the widened chunks that lie inside one text."""
    w = cut_window(span)
    cuts = block.cuts(w)
    piece = np.searchsorted(block.starts, cuts, side="right") - 1
    a, b = cuts[:-1], cuts[1:]
    begin, end = a - (GEAR - 1) - (w - 1), b + w
    ok = (piece[:-1] == piece[1:]) & (begin >= block.starts[piece[:-1]]) & (end <= block.ends[piece[:-1]]) & (end - begin <= span)
    return begin[ok], end[ok], piece[:-1][ok]


def chunk_digests(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(digest, key): the widened chunks of all texts, each distinct one of a text once or a few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, core, values, _ in _blocks(batches, 2 * span):
            begin, end, piece = _chunks(block, span)
            own = (begin >= core[piece, 0]) & (begin < core[piece, 1])
            begin, end, piece = begin[own], end[own], piece[own]
            keys = np.array([v[0] for v in values])[piece] if len(piece) else np.empty(0, np.int64)
            digest = block.digest(begin, end, 0)
            order = np.lexsort((keys, digest))
            digest, keys = digest[order], keys[order]
            fresh = np.r_[True, (digest[1:] != digest[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(digest[fresh]), pa.array(keys[fresh])], names=["digest", key])

    return df.select(key, text).mapInArrow(run, f"digest bigint, `{key}` bigint")


def _groups(rows: DataFrame, digests: list[str], key: str) -> DataFrame:
    """digests, first, last, n of what more than one document has. Combined before it is shuffled; a row a group."""
    grouped = rows.groupBy(*digests).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(grouped.where(F.col("first") != F.col("last")))


def _held_twice(rows: DataFrame, digests: list[str], key: str) -> DataFrame:
    """The rows whose digests another document has, too."""
    groups = _groups(rows, digests, key)
    return salted_join(rows, groups.select(*digests), digests, hot_rows(groups, digests), key, "left_semi")


def _met(block: Block, span: int, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, piece, digest) of the chunks whose digests are in the bitmap."""
    begin, end, piece = _chunks(block, span)
    digest = block.digest(begin, end, 0)
    hit = hash_hits(bitmap, digest.view(np.uint64))
    return begin[hit], end[hit], piece[hit], digest[hit]


def _batches(names: list[str], columns: list[np.ndarray], missing: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    missing = missing or {}
    for k in range(0, len(columns[0]), 100_000):
        cut = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(x[cut], mask=missing[n][cut] if n in missing else None) for n, x in zip(names, columns)], names=names)


def _keys(values: list[tuple], piece: np.ndarray) -> np.ndarray:
    return np.array([v[0] for v in values])[piece] if len(piece) else np.empty(0, np.int64)


def _edge_spans(df: DataFrame, key: str, text: str, span: int, bitmap: Broadcast) -> DataFrame:
    """(digest, key, d0, d1): of each chunk in the bitmap the spans that begin and end with it. d0 and d1 are null where
    the text is too short on that side."""
    names = ["digest", key, "d0", "d1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, core, values, _ in _blocks(batches, 2 * span):
            begin, end, piece, digest = _met(block, span, bitmap.value)
            own = (begin >= core[piece, 0]) & (begin < core[piece, 1])
            at = np.r_[begin[own], end[own] - span]
            piece, digest = np.r_[piece[own], piece[own]], np.r_[digest[own], digest[own]]
            off = (at < block.starts[piece]) | (at + span > block.ends[piece])
            at = np.where(off, block.starts[piece], at)
            stop = np.where(off, at, at + span)
            yield from _batches(names, [digest, _keys(values, piece), block.digest(at, stop, 0), block.digest(at, stop, 1)], {"d0": off, "d1": off})

    return df.select(key, text).mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def _span_digests(df: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """(d0, d1, key, at) of all spans that hold a chunk whose digest is in ``marks``, sorted digests that ``df`` has,
    besides; ``at`` is where the span begins in its text."""
    names = ["d0", "d1", key, "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, core, values, offset in _blocks(batches, 2 * span):
            begin, end, piece = _chunks(block, span)
            digest = block.digest(begin, end, 0)
            marked = np.zeros(len(digest), bool)
            bounds = np.searchsorted(piece, np.arange(len(values) + 1))
            for i, v in enumerate(values):
                if bounds[i] < bounds[i + 1]:
                    marked[bounds[i] : bounds[i + 1]] = np.isin(digest[bounds[i] : bounds[i + 1]], np.asarray(v[1], np.int64))
            begin, end, piece = begin[marked], end[marked], piece[marked]
            flag = np.zeros(len(block.points) + 1, np.int32)
            lo, hi = np.maximum(end - span, block.starts[piece]), np.minimum(begin, block.ends[piece] - span)
            ok = lo <= hi
            np.add.at(flag, lo[ok], 1)
            np.add.at(flag, hi[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(flag) > 0)
            piece = np.searchsorted(block.starts, at, side="right") - 1
            own = (at >= core[piece, 0]) & (at < core[piece, 1]) if len(at) else np.empty(0, bool)
            at, piece = at[own], piece[own]
            yield from _batches(names, [block.digest(at, at + span, 0), block.digest(at, at + span, 1), _keys(values, piece), at + offset[piece]])

    return df.select(key, text, "marks").mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def _contexts(df: DataFrame, key: str, text: str, span: int, bitmap: Broadcast) -> DataFrame:
    """(d0, d1, digest, key, at, n): each chunk in the bitmap with its context, the ``n`` characters from place ``at`` on
    that all spans with this chunk lie in."""
    names = ["d0", "d1", "digest", key, "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, core, values, offset in _blocks(batches, 2 * span):
            begin, end, piece, digest = _met(block, span, bitmap.value)
            lo, hi = np.maximum(end - span, block.starts[piece]), np.minimum(begin + span, block.ends[piece])
            own = (begin >= core[piece, 0]) & (begin < core[piece, 1]) & (hi - lo >= span)
            lo, hi, piece, digest = lo[own], hi[own], piece[own], digest[own]
            yield from _batches(names, [block.digest(lo, hi, 0), block.digest(lo, hi, 1), digest, _keys(values, piece), lo + offset[piece], hi - lo])

    return df.select(key, text).mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def _with_marks(df: DataFrame, marks: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with the sorted digests marked in them; a text's own chunks bound the list. Only texts whose keys hit a
    bitmap of the marks' keys are exchanged."""
    lists = cut_lineage(marks.groupBy(key).agg(F.sort_array(F.collect_set("digest")).alias("marks")))
    bitmap = bitmap_of(lists.select(F.xxhash64(key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(bitmap.value, batch.column(2).to_numpy()))).select([0, 1])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, text))
    some = df.select(key, text, place_of(F.xxhash64(key)).alias("_place")).mapInArrow(run, kinds)
    return some.hint("merge").join(lists.hint("merge"), key)


def _shared_chunks(df: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """(digest, n): the chunks of more than one document, and how many hold them."""
    return _groups(chunk_digests(df, key, text, span), ["digest"], key).select("digest", "n")


def _exactly(digests: DataFrame, groups: DataFrame) -> DataFrame:
    """Each of the digests that is of several documents, once."""
    return digests.distinct().hint("merge").join(groups.select("digest").hint("merge"), "digest", "left_semi")


def shared_documents(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(key): the documents that hold at least ``span`` consecutive code points which also stand in another document.

    ``key`` is a unique integer. Null, empty and shorter texts hold no span; a repetition within one document is no
    case. Characters are compared by two independent 64-bit digests of exactly ``span`` code points.
    """
    groups = _shared_chunks(df, key, text, span)
    spots = cut_lineage(_edge_spans(df, key, text, span, bitmap_of(groups.select("digest"))))
    known = cut_lineage(_held_twice(spots.where("d0 is not null").select("d0", "d1", key), ["d0", "d1"], key).select(key).distinct())
    # What is not settled: documents with shared chunks but no such span. Their chunks are looked at everywhere.
    doubtful = _exactly(spots.select("digest", key).hint("merge").join(known.hint("merge"), key, "left_anti").select("digest"), groups)
    rest = salted_join(spots.select("digest", key), doubtful, ["digest"], hot_rows(groups, ["digest"]), key, "left_semi")
    spans = cut_lineage(_span_digests(_with_marks(df, rest, key, text), key, text, span))
    return known.unionByName(_held_twice(spans, ["d0", "d1"], key).select(key)).distinct()


def _covered(df: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """(key, at, n): stretches of each document, which may overlap, that make up all its shared spans."""
    shared = _shared_chunks(df, key, text, span)
    contexts = cut_lineage(_contexts(df, key, text, span, bitmap_of(shared.select("digest"))))
    groups = _groups(contexts, ["d0", "d1"], key)
    chunks = cut_lineage(
        salted_join(contexts, groups.select("d0", "d1", "first", "last"), ["d0", "d1"], hot_rows(groups, ["d0", "d1"]), key, "left").select("digest", key, "at", "n", "first", "last")
    )
    # A chunk is open if no other document has its context: its spans are looked at one by one. Of the documents that
    # agree in a context, two stand for all.
    is_open = F.col("first").isNull()
    doubtful = _exactly(chunks.where(is_open).select("digest"), shared)
    asked = chunks.where(is_open | (F.col(key) == F.col("first")) | (F.col(key) == F.col("last")))
    rest = salted_join(asked.select("digest", key), doubtful, ["digest"], hot_rows(shared, ["digest"]), key, "left_semi")
    spans = cut_lineage(_span_digests(_with_marks(df, rest, key, text), key, text, span))
    single = _held_twice(spans, ["d0", "d1"], key).select(key, "at", F.lit(span).cast("long").alias("n"))
    return chunks.where(~is_open).select(key, "at", "n").unionByName(single)


def shared_stretches(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(key, begin, n_chars): the longest runs of code points of each document that all lie in spans which also stand in
    some other document; ``begin`` counts from 0.

    Runs don't overlap or touch, and have at least ``span`` code points. ``key`` and cases as in ``shared_documents``,
    whose documents are those with a run. The runs of a document lie in one task; its length bounds them.
    """
    before = Window.partitionBy(key).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(F.col("at") + F.col("n")).over(before)  # null at the first
    fresh = F.when(reached.isNull() | (F.col("at") > reached), F.col("at"))
    return (
        _covered(df, key, text, span)
        .withColumn("_fresh", fresh)
        .withColumn("begin", F.max("_fresh").over(so_far))
        .groupBy(key, "begin")
        .agg((F.max(F.col("at") + F.col("n")) - F.col("begin")).alias("n_chars"))
    )


def shared_amounts(df: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(key, n_chars, n_shared, share, n_spans) of every document: how many of its code points lie in any ``span``
    consecutive ones that also stand in another document, as a number and a share, and in how many separate stretches.

    ``key`` is a unique integer. A document that shares nothing has 0 of each, so has null text, whose n_chars is null.
    Compared as in ``shared_documents``, whose documents are those with n_shared > 0.
    """
    sums = shared_stretches(df, key, text, span).groupBy(key).agg(F.sum("n_chars").alias("n_shared"), F.count(F.lit(1)).alias("n_spans"))
    n_shared = F.coalesce("n_shared", F.lit(0).cast("long"))
    return (
        df.select(key, F.length(text).cast("long").alias("n_chars"))
        .hint("merge")
        .join(sums.hint("merge"), key, "left")
        .select(
            key,
            "n_chars",
            n_shared.alias("n_shared"),
            F.coalesce(F.try_divide(n_shared, "n_chars"), F.lit(0.0)).alias("share"),
            F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        )
    )
