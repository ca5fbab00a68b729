"""Evaluation texts inside training text, by template canonicalisation.

Texts are brought to NFKC and lower case and cut into words. Numbers, units and names become typed placeholders; what
is left is the template. Windows of template words are joined by hash; then the slots, the words behind the
placeholders, are checked: equal slots mean the passage itself, a renaming that is one-to-one throughout a passage a
re-parameterised copy.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.sieve import bitmap_of, hash_hits, hot_rows, salted_join
from tokenloom.session import cut_lineage

WINDOW = 12
#: A word in fewer items than this is taken for a name; so is any word that no item holds.
NAME_ITEMS = 3
#: Windows and words of the items may be this many to be sent to all tasks (about 50 MB); beyond, bitmaps of their hashes
#: are sent, and the windows that hit them go through a shuffle join.
BROADCAST_WINDOWS = 500_000
#: Words handled at once in a task.
BLOCK_WORDS = 400_000
#: Longer texts are cut before white space into parts of this many characters.
PART_CHARS = 1_000_000

#: Words for units.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years percent hz khz mhz ghz b kb mb gb tb v kv w kw j kj pa kpa usd eur dollars euros "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters degrees celsius".split()
)

_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"(?<=\S)\s")
NUMBER, UNIT, NAME = 1, 2, 3


def words_of(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def _parts(text: str, overlap: int) -> Iterator[list[str]]:
    """Words of the text, in parts that share ``overlap`` words. White space is a safe place to cut: neither
    normalization nor lower case looks across it."""
    if len(text) <= PART_CHARS:
        yield words_of(text)
        return
    begin, tail = 0, []
    while begin < len(text):
        cut = _SPACE.search(text, begin + PART_CHARS)
        end = cut.start() if cut else len(text)
        words = tail + words_of(text[begin:end])
        yield words
        tail, begin = words[-overlap:] if overlap else [], end


class Canon(dict):
    """word -> number of its row in ``template`` (hash of the word or its placeholder) and ``raw`` (hash of the word)."""

    def __init__(self, common: frozenset[str] | set[str]):
        super().__init__()
        self.common, self.templates, self.raws = common, [], []

    def __missing__(self, word: str) -> int:
        import xxhash

        raw = xxhash.xxh3_64_intdigest(word)
        if word in UNITS:
            kind = UNIT
        elif any(c.isdigit() for c in word):
            kind = NUMBER
        elif word not in self.common:
            kind = NAME
        else:
            kind = raw | 4
        self.templates.append(kind)
        self.raws.append(raw)
        n = self[word] = len(self)
        return n

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.templates, np.uint64), np.array(self.raws, np.uint64)


def _powers(seed: int, n: int) -> list[np.uint64]:
    rng = np.random.default_rng(seed)
    return [np.uint64(x) for x in rng.integers(1, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _window_hash(values: np.ndarray, window: int, seed: int) -> np.ndarray:
    n = len(values) - window + 1
    out = np.zeros(max(0, n), np.uint64)
    mixed = _mix(values)
    for j, p in enumerate(_powers(seed, window)):
        if n > 0:
            out += mixed[j : j + n] * p
    return _mix(out)


def _isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array, behind a bitmap that rules most values out."""
    if not len(known):
        return np.zeros(len(values), bool)
    shift = np.uint64(64 - 22)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[known >> shift] = True
    maybe = np.flatnonzero(bitmap[values >> shift])
    at = np.searchsorted(known, values[maybe])
    hit = known[np.minimum(at, len(known) - 1)] == values[maybe]
    out = np.zeros(len(values), bool)
    out[maybe[hit]] = True
    return out


def template_windows(
    df: DataFrame,
    key: str,
    text: str,
    common,
    window: int = WINDOW,
    templates=None,
    pairs=None,
    sieve: tuple | None = None,
    min_literal: int = 0,
    with_words: bool = True,
    places: bool = False,
    listed: bool = False,
) -> DataFrame:
    """(key, template bigint, slots bigint, n_literal int, words string[, at bigint]): all windows of all texts, each
    once. ``places``: with ``at``, the number of words before the window in its text. ``listed``: ``df`` has, besides,
    ``_common``, those words of the text that are kept as they are.

    ``common`` is a broadcast set of words kept as they are. ``templates`` and ``pairs`` are broadcast sorted arrays
    of template hashes, and of combined template and slot hashes; windows not among them are dropped here. ``sieve`` are
    two broadcast bitmaps instead, of template hashes and of slot hashes, or, with the third entry False, of the template
    hashes' other half; what doesn't hit both is dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "template", "slots", "n_literal", "words"] + ["at"] * places
        held = set() if listed else common.value
        canon = Canon(held)
        known = None if templates is None else templates.value
        paired = None if pairs is None else pairs.value

        def block(words: list[str], owner: list[int], length: list[int], base: list[int]) -> Iterator[pa.RecordBatch]:
            if len(words) < window:
                return
            number = np.fromiter(map(canon.__getitem__, words), np.int64, len(words))
            tem, raw = canon.arrays()
            t, r = tem[number], raw[number]
            template = _window_hash(t, window, 1)
            doc = np.repeat(np.arange(len(length)), length)
            shift = np.array(base, np.int64) - np.r_[0, np.cumsum(length)[:-1]]  # from places in the block to places in the text
            whole = doc[: len(template)] == doc[window - 1 :]
            keep = whole if known is None else whole & _isin(template, known)
            if sieve:
                keep &= hash_hits(sieve[0].value, template)
                if not sieve[2]:
                    keep &= hash_hits(sieve[1].value, template << np.uint64(32))
            at = np.flatnonzero(keep)
            if not len(at):
                return
            if paired is None and known is None and sieve is None:
                slots = _window_hash(r, window, 2)[at]
            else:
                mixed, slots = _mix(r), np.zeros(len(at), np.uint64)
                for j, p in enumerate(_powers(2, window)):
                    slots += mixed[at + j] * p
                slots = _mix(slots)
            if paired is not None:
                hit = _isin(_mix(template[at] + slots * np.uint64(3)), paired)
                at, slots = at[hit], slots[hit]
            if sieve and sieve[2]:
                hit = hash_hits(sieve[1].value, slots)
                at, slots = at[hit], slots[hit]
            literal = np.r_[0, np.cumsum(t > 3)]
            n_literal = literal[at + window] - literal[at]
            if min_literal:
                enough = n_literal >= min_literal
                at, slots, n_literal = at[enough], slots[enough], n_literal[enough]
            for k in range(0, len(at), 50_000):
                a = at[k : k + 50_000]
                shown = [" ".join(words[x : x + window]) for x in a] if with_words else [None] * len(a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner[x] for x in doc[a]]),
                        pa.array(template[a].view(np.int64)),
                        pa.array(slots[k : k + 50_000].view(np.int64)),
                        pa.array(n_literal[k : k + 50_000].astype(np.int32)),
                        pa.array(shown, pa.string()),
                    ]
                    + [pa.array(a + shift[doc[a]])] * places,
                    names=names,
                )

        for batch in batches:
            words: list[str] = []
            owner, length, base = [], [], []
            lists = batch.column(2).to_pylist() if listed else [None] * batch.num_rows
            for k, value, own in zip(batch.column(0).to_pylist(), batch.column(1), lists):
                value = value.as_py()
                if not value:
                    continue
                if own:
                    held.update(own)
                at = 0
                for part in _parts(value, window - 1):
                    words += part
                    owner.append(k)
                    length.append(len(part))
                    base.append(at)
                    at += max(0, len(part) - (window - 1))  # the next part begins with this one's last words
                    if len(words) >= BLOCK_WORDS:
                        yield from block(words, owner, length, base)
                        words, owner, length, base = [], [], [], []
                        if len(canon) > 1_000_000:
                            held = set(own or ()) if listed else common.value
                            canon.__init__(held)
                            canon.clear()
            yield from block(words, owner, length, base)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, *["_common"] * listed).mapInArrow(
        run, f"`{key}` {kind}, template bigint, slots bigint, n_literal int, words string" + ", at bigint" * places
    )


def common_words(items: DataFrame, key: str, text: str, name_items: int = NAME_ITEMS) -> DataFrame:
    """Words that at least ``name_items`` items hold: all others are taken for names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [w for t in batch.column(0).to_pylist() if t for part in _parts(t, 0) for w in set(part)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    return (
        items.select(text)
        .mapInArrow(run, "word string")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_items"))
        .where(F.col("n_items") >= name_items)
        .select("word")
    )


def _with_common(df: DataFrame, key: str, text: str, common: DataFrame) -> DataFrame:
    """Texts with ``_common``: their words among those of ``common``, by a shuffle join. A text's own words bound the
    list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                for part in _parts(t.as_py() or "", 0):
                    words = pa.array(list(dict.fromkeys(part)), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(words), k.type), words], names=[key, "word"])

    words = df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, word string")
    lists = words.hint("merge").join(common.hint("merge"), "word").groupBy(key).agg(F.collect_set("word").alias("_common"))
    return df.select(key, text).hint("merge").join(lists.hint("merge"), key, "left")


def _fits(df: DataFrame, limit: int) -> pa.Table | None:
    """The rows if they are at most ``limit``, else None."""
    rows = df.limit(limit + 1).toArrow()
    return rows if rows.num_rows <= limit else None


class Items:
    """The items' side: its common words, its windows, and what of them may be sent to all tasks: sorted hashes, or
    bitmaps of them, ``exact`` if slots have to agree."""

    def __init__(
        self, items: DataFrame, key: str, text: str, window: int, name_items: int = NAME_ITEMS, limit: int = BROADCAST_WINDOWS, places: bool = False, exact: bool = False
    ):
        sc = items.sparkSession.sparkContext
        words = _fits(common_words(items, key, text, name_items), limit)
        # With more words than may be sent, no word is kept as it is: coarser templates, which change no result of
        # ``leaks``. Where templates count (``places``), each text gets the list of its own common words instead.
        self.listed = cut_lineage(common_words(items, key, text, name_items)) if words is None and places else None
        self.common = sc.broadcast(frozenset(words.column(0).to_pylist() if words is not None else ()))
        self.windows = template_windows(
            self.with_common(items, key, text), key, text, self.common, window, places=places, listed=self.listed is not None
        ).distinct()
        hashes = _fits(self.windows.select("template", "slots"), limit)  # as many rows as would be broadcast
        self.small = hashes is not None
        self.templates = self.pairs = self.sieve = None
        if hashes is None:
            self.windows = cut_lineage(self.windows)
            second = F.col("slots") if exact else F.shiftleft("template", 32)
            self.sieve = bitmap_of(self.windows.select("template")), bitmap_of(self.windows.select(second.alias("h"))), exact
        else:
            template, slots = (hashes.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("template", "slots"))
            self.templates = sc.broadcast(np.unique(template))
            self.pairs = sc.broadcast(np.unique(_mix(template + slots * np.uint64(3))))


    def joined(self, found: DataFrame, side: DataFrame, keys: list[str], doc_key: str) -> DataFrame:
        """The documents' windows with the items' of equal ``keys``. Templates that many windows have are spread."""
        if self.small:
            return found.join(F.broadcast(side), keys)  # at most BROADCAST_WINDOWS rows, counted
        kept = cut_lineage(found)
        by = [k for k in keys if k != "words"]
        counts = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        if by == keys:
            return salted_join(kept, side, keys, hot_rows(counts, by), doc_key, "inner")
        apart = side.withColumnRenamed("words", "_words_too")
        return salted_join(kept, apart, by, hot_rows(counts, by), doc_key, "inner").where(F.col("words") == F.col("_words_too")).drop("_words_too")

    def with_common(self, df: DataFrame, key: str, text: str) -> DataFrame:
        return df if self.listed is None else _with_common(df, key, text, self.listed)


def _apart(items: DataFrame, item_key: str, doc_key: str) -> tuple[DataFrame, str]:
    if item_key != doc_key:
        return items, item_key
    return items.withColumnRenamed(item_key, f"item_{item_key}"), f"item_{item_key}"


def leaks(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, limit: int = BROADCAST_WINDOWS
) -> DataFrame:
    """(doc_key, item_key): each document with each item of which it holds ``window`` consecutive words in order.

    Windows meet by template hash, must have equal slots, and are at last compared word by word. Null, empty and blank
    texts and items of fewer words hold no window. Copies of a document each come out. Of tables whose keys have the
    same name the item's is called ``item_<name>``.
    """
    items, item_key = _apart(items, item_key, doc_key)
    known = Items(items, item_key, item_text, window, limit=limit, exact=True)
    found = template_windows(docs, doc_key, doc_text, known.common, window, known.templates, known.pairs, known.sieve)
    side = known.windows.select("template", "slots", "words", item_key)
    return known.joined(found, side, ["template", "slots", "words"], doc_key).select(doc_key, item_key).distinct()


def reparameterised(
    docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW, min_literal: int = 6, limit: int = BROADCAST_WINDOWS
) -> DataFrame:
    """doc_key, item_key, n_windows, n_words, n_changed: documents with an item's template, slots consistent.

    Windows with at least ``min_literal`` words that are no placeholders meet by template. A passage is a stretch of
    the document that such windows cover without a gap, at one and the same distance to the item. In a passage, each
    slot word of the item must stand for one word only, and the reverse; a pair comes out if any of its passages is
    consistent, and only consistent ones count. n_windows counts their distinct windows, n_words the distinct words of
    the item met, n_changed those of them that differ somewhere. Keys are unique in both tables.
    """
    items, item_key = _apart(items, item_key, doc_key)
    # In a table of a few items hardly any word is in three of them, and all would be names.
    name_items = min(NAME_ITEMS, max(1, items.where(F.col(item_text).isNotNull()).count() // 2))
    known = Items(items, item_key, item_text, window, name_items, limit, places=True)
    rows = known.with_common(docs, doc_key, doc_text)
    found = template_windows(
        rows, doc_key, doc_text, known.common, window, known.templates, None, known.sieve, min_literal, places=True, listed=known.listed is not None
    )
    side = known.windows.where(F.col("n_literal") >= min_literal).select(
        "template", F.col("words").alias("_item_words"), F.col("at").alias("_item_at"), item_key
    )
    passage = [doc_key, item_key, "_distance", "_begin"]
    line = Window.partitionBy(doc_key, item_key, "_distance").orderBy("at")
    last = F.lag("at").over(line)
    met = cut_lineage(
        known.joined(found, side, ["template"], doc_key)
        .withColumn("_distance", F.col("at") - F.col("_item_at"))
        .withColumn("_new", F.when(last.isNull() | (F.col("at") > last + window), F.col("at")))
        .withColumn("_begin", F.max("_new").over(line))
        .select(*passage, "template", F.col("words").alias("_words"), "_item_words")
    )
    zipped = F.explode(F.arrays_zip(F.split("_item_words", " ").alias("i"), F.split("_words", " ").alias("d"))).alias("z")
    named = met.select(*passage, zipped).select(*passage, F.col("z.i").alias("_i"), F.col("z.d").alias("_d")).distinct()
    consistent = (
        named.groupBy(*passage)
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_i").alias("n_i"), F.count_distinct("_d").alias("n_d"))
        .where((F.col("n") == F.col("n_i")) & (F.col("n") == F.col("n_d")))
        .select(*passage)
    )
    changed = F.max((F.col("_i") != F.col("_d")).cast("int"))
    words = named.hint("merge").join(consistent.hint("merge"), passage, "left_semi").groupBy(doc_key, item_key, "_i").agg(changed.alias("changed"))
    counts = met.hint("merge").join(consistent.hint("merge"), passage, "left_semi").select(doc_key, item_key, "template", "_words", "_item_words").distinct()
    return (
        counts.groupBy(doc_key, item_key)
        .agg(F.count(F.lit(1)).alias("n_windows"))
        .hint("merge")
        .join(words.groupBy(doc_key, item_key).agg(F.count(F.lit(1)).alias("n_words"), F.sum("changed").alias("n_changed")).hint("merge"), [doc_key, item_key])
        .select(doc_key, item_key, "n_windows", "n_words", "n_changed")
    )
