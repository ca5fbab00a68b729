"""Token counts of every text, and totals per source, language and domain, under an existing tokenizer.

Texts are split by the tokenizer's own pattern and pieces are counted before anything is shuffled; each distinct piece
is tokenized once. The lengths of the most frequent pieces, a list of bounded size, are sent to all tasks, which add
them up where the texts are; what a text has of other pieces is joined to their lengths. The tokenizer merges only
within pieces and normalizes nothing, so the counts equal those of encoding every text.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.vocab import BYTE_BPE_50K, PATTERN, TOKENIZER_DIR, encoder, safe_parts
from tokenloom.session import cut_lineage

#: Distinct pieces held in a task before their counts are handed on.
HELD_PIECES = 200_000
#: Pieces whose lengths are sent to all tasks; with NAME_CHARS that is about 30 MB at most, a few in practice.
SENT_PIECES = 200_000
#: Longer pieces go by a digest.
NAME_CHARS = 64


def _name(piece: str) -> str:
    """The piece, or its 128-bit digest if it is long. No short piece looks like a digest: those begin with NUL and 32
    hexadecimal digits, which the pattern never leaves in one piece."""
    if len(piece) <= NAME_CHARS:
        return piece
    import xxhash

    return "\0" + xxhash.xxh3_128_hexdigest(piece.encode("utf-8", "surrogatepass"))


def piece_counts(df: DataFrame, text: str) -> DataFrame:
    """(piece, freq): how often each piece of the pattern occurs in all texts. Null and empty texts have no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        held: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, freqs = list(held), list(held.values())
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[k : k + 20_000], pa.string()), pa.array(freqs[k : k + 20_000], pa.int64())], names=["piece", "freq"]
                )
            held.clear()

        for batch in batches:
            for value in batch.column(0):
                for part in safe_parts(value.as_py() or ""):
                    held.update(split(part))
                if len(held) > HELD_PIECES:
                    yield from out()
        yield from out()

    return df.select(text).mapInArrow(run, "piece string, freq bigint").groupBy("piece").agg(F.sum("freq").alias("freq"))


def piece_lengths(counts: DataFrame, vocabulary: str = BYTE_BPE_50K, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(name, freq, n): each distinct piece, tokenized once, with its number of tokens."""
    path = os.path.join(directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            n = [len(enc.encode_ordinary(p)) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([_name(p) for p in pieces], pa.string()), batch.column(1), pa.array(n, pa.int64())], names=["name", "freq", "n"])

    return cut_lineage(counts.select("piece", "freq").mapInArrow(run, "name string, freq bigint, n bigint"))


def _most_frequent(lengths: DataFrame, limit: int) -> tuple[dict[str, int], int]:
    """Lengths of the pieces that occur at least so often, and this number: the least that leaves at most ``limit``.

    Found from the numbers of pieces by the logarithm of their frequency, a few hundred rows.
    """
    steps = lengths.groupBy(F.floor(F.log2("freq") * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("freq").alias("low"))
    least, total = 2**62, 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):
        total += row.k
        if total > limit:
            break
        least = row.low
    sent = lengths.where(F.col("freq") >= least).select("name", "n").toArrow()  # at most ``limit`` rows
    return dict(zip(sent.column(0).to_pylist(), sent.column(1).to_pylist())), least


def document_tokens(
    texts: DataFrame, keep: Sequence[str], text: str, vocabulary: str = BYTE_BPE_50K, directory: str = TOKENIZER_DIR, sent_pieces: int | None = None
) -> DataFrame:
    """``keep`` (columns of the text), n_chars, n_tokens of each row of ``texts``.

    Null and empty texts have 0 tokens, null text null characters. Rows map one to one, repeated rows stay repeated; an
    empty table gives no rows. No piece of more than a bounded number of occurrences is ever a join key.
    """
    keep = list(keep)
    lengths = piece_lengths(piece_counts(texts, text), vocabulary, directory)
    sent, least = _most_frequent(lengths, SENT_PIECES if sent_pieces is None else sent_pieces)
    known = texts.sparkSession.sparkContext.broadcast(sent)
    rare = pa.list_(pa.struct([("name", pa.string()), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(PATTERN).findall
        length = known.value.get
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            totals, others = [], []
            for value in batch.column(0):
                total, rest = 0, Counter()
                for part in safe_parts(value.as_py() or ""):
                    for piece in split(part):
                        n = length(piece if len(piece) <= NAME_CHARS else _name(piece))
                        if n is None:
                            rest[_name(piece)] += 1
                        else:
                            total += n
                totals.append(total)
                others.append([{"name": p, "k": k} for p, k in rest.items()])
            rows = pa.array(range(number, number + len(totals)), pa.int64())
            number += len(totals)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], rows, pa.array(totals, pa.int64()), pa.array(others, rare)], names=[*batch.schema.names[1:], "_row", "_n", "_rest"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_chars bigint, _row bigint, _n bigint, _rest array<struct<name:string,k:bigint>>"])
    counted = cut_lineage(texts.select(F.col(text).alias("_text"), *keep, F.length(text).cast("long").alias("n_chars")).mapInArrow(run, schema))
    others = lengths.where(F.col("freq") < least).select("name", "n")
    rest = (
        counted.select("_row", F.inline("_rest"))
        .hint("merge")
        .join(others.hint("merge"), "name")
        .groupBy("_row")
        .agg(F.sum(F.col("n") * F.col("k")).alias("_more"))
    )
    joined = counted.drop("_rest").hint("merge").join(rest.hint("merge"), "_row", "left")
    return joined.select(*keep, "n_chars", (F.col("_n") + F.coalesce("_more", F.lit(0))).alias("n_tokens"))


def token_budget(counted: DataFrame, by: Sequence[str], known: str) -> DataFrame:
    """Per slice ``by``, from ``document_tokens``: n_texts, n_empty (null or empty), n_chars, n_tokens, n_known,
    known_tokens.

    ``known`` is a column with the known token count of some texts, null for others. Null is a value of its own in a
    slice. Sums are combined before they are shuffled.
    """
    return counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.coalesce("n_chars", F.lit(0)) == 0).alias("n_empty"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count(known).alias("n_known"),
        F.coalesce(F.sum(known), F.lit(0)).alias("known_tokens"),
    )
