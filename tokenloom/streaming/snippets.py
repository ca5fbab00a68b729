"""Annotation of snippets as they arrive. Each snippet stands alone, so no state crosses a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokenloom.operators.annotate import annotate_tokens
from tokenloom.sources.schema import SNIPPET


def read_snippet_stream(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    """Parquet snippets added to a directory."""
    return spark.readStream.schema(SNIPPET).option("maxFilesPerTrigger", max_files).parquet(directory)


def annotate_stream(snippets: DataFrame, output: str, checkpoint: str, tokenizer=None, available_now: bool = True) -> StreamingQuery:
    """Writes the annotation of each batch to a folder of its own, ``batch=<id>``. A batch that is run again after a
    failure replaces its folder, so every snippet comes out exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        annotate_tokens(batch, tokenizer).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = snippets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def status_counts(snippets: DataFrame, tokenizer=None) -> DataFrame:
    """Snippets per language and parser status, kept up to date over the stream."""
    from tokenloom.operators.annotate import parse_snippets

    return parse_snippets(snippets, tokenizer).groupBy("language", "status").agg(F.count(F.lit(1)).alias("n"))
