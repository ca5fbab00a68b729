"""Training items of snippets and texts."""

from pyspark.sql import functions as F

from tests.test_operators import snippets
from tokenloom.functions.labels import CODE_LABELS
from tokenloom.operators import datasets, tokens


def test_code_items_and_padding(spark):
    items = datasets.code_items(snippets(spark, "x = 1", "", None, "def f(): pass"))
    got = {r.snippet_id: r for r in items.collect()}
    assert [n for n in got["0"].label_names if n not in ("text", "whitespace")] == ["name", "operator", "number"]
    for r in got.values():
        assert len(r.input_ids) == len(r.labels) == len(r.offsets) == r.length
        assert [CODE_LABELS[i] for i in r.labels] == r.label_names
    assert got["1"].length == got["2"].length == 0
    padded = {r.snippet_id: r for r in datasets.pad_items(items, ["snippet_id"], 2).collect()}
    assert len(padded["1"].labels) == len(padded["0"].labels) == got["0"].length and set(padded["1"].labels) == {-100}
    assert {r.length for r in datasets.code_items(snippets(spark, "a b c d"), max_length=2).collect()} == {2}


def test_text_items(spark):
    df = spark.createDataFrame([(1, "one 2"), (2, "x")], "id long, text string")
    rows = tokens.label_text_tokens(tokens.text_tokens(df, ["id"], "text"), exact=True).withColumn("token_id", F.crc32(F.col("token_text").cast("binary")))
    got = {r.id: r.label_names for r in datasets.text_items(rows, ["id"]).collect()}
    assert got == {1: ["word", "whitespace", "number"], 2: ["word"]}
