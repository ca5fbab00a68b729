"""Source files that do not parse in the language they are filed under."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.syntax.languages import check, language_of


def check_files(df: DataFrame, keys: list[str], language: str, code: str) -> DataFrame:
    """keys, valid boolean, dialect string, error_place int of each row; row-local, one pass, no shuffle.

    A generalised LL parser runs every dialect grammar of the language; a file is invalid if all reject it.
    error_place is the furthest character a dialect reached. Null, empty and blank code is null (no case), as is code
    in an unknown language; names are compared without case and surrounding blanks. Repeated rows stay repeated. Memory
    follows the nesting of a file, besides a few bytes for each of its tokens.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            names = [language_of(x) for x in batch.column(n).to_pylist()]
            valid, dialect, place = [], [], []
            for name, text in zip(names, batch.column(n + 1)):
                text = text.as_py()
                v = check(text, name) if text and not text.isspace() else (None, None, None)
                valid.append(v[0])
                dialect.append(v[1])
                place.append(v[2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(valid, pa.bool_()), pa.array(dialect, pa.string()), pa.array(place, pa.int32())],
                names=[*keys, "valid", "dialect", "error_place"],
            )

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "valid boolean, dialect string, error_place int"])
    plain = df.select(*keys, F.col(language).alias("_language"), F.col(code).alias("_code"))
    return plain.mapInArrow(run, schema)


def repository_of(path: Column) -> Column:
    """The first two segments of a file path; ``./`` in front is dropped, backslashes are slashes. Null if the path is
    null or has no second segment."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)))


def latest_hint(parses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hint: the status of the latest parser run of each file; ties go to the greatest version, then status."""
    return parses.groupBy(*keys).agg(F.max(F.struct("parsed_at", "parser_version", "status")).alias("r")).select(*keys, F.col("r.status").alias("hint"))


def invalid_rates(checked: DataFrame, by: list[str], hints: DataFrame, keys: list[str]) -> DataFrame:
    """by, n_files, n_checked, n_invalid, invalid_rate, n_hint_wrong: per repository and language.

    n_checked leaves out files that are no case; the rate is null where there are none. n_hint_wrong counts checked
    files whose hint (ok against any error) says otherwise; files without a hint don't count. ``checked`` has each file
    once.
    """
    bad_hint = F.when(F.col("hint") == "ok", F.lit(False)).when(F.col("hint").isin("parsed_with_errors", "error"), F.lit(True))
    joined = checked.hint("merge").join(hints.hint("merge"), keys, "left")
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count("valid").alias("n_checked"),
        F.count_if(~F.col("valid")).alias("n_invalid"),
        F.round(F.try_divide(F.count_if(~F.col("valid")), F.count("valid")), 6).alias("invalid_rate"),
        F.count_if(bad_hint == F.col("valid")).alias("n_hint_wrong"),
    )
