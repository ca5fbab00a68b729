"""Round trips of readers and writers, sidecars, and the stream."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tokenloom.sources import snippets as sn
from tokenloom.sources import tables as tb
from tokenloom.streaming.snippets import annotate_stream, read_snippet_stream, status_counts


def _tree(root):
    for lang, idx, code in [("C#", "1-Csharp-1", "class A {}"), ("C++", "1-Cpp-1", "int x;"), ("Python", "1-Py-1", "x = 1\n"), ("Python", "1-Py-2", "")]:
        (root / lang).mkdir(parents=True, exist_ok=True)
        (root / lang / f"{idx}.json").write_text(json.dumps({"idx": idx, "code": code, "comment": "é"}, indent=1))
    return str(root)


def test_snippet_tree(spark, tmp_path):
    df = sn.read_snippets(spark, _tree(tmp_path))
    assert {(r.language, r.idx, r.global_idx) for r in df.collect()} == {("C#", "1-Csharp-1", "1-1"), ("C++", "1-Cpp-1", "1-1"), ("Python", "1-Py-1", "1-1"), ("Python", "1-Py-2", "1-2")}
    assert sn.read_snippets(spark, str(tmp_path), ["Python"]).count() == 2
    (tmp_path / "Python" / "bad.json").write_text('{"idx": "x"}')
    with pytest.raises(Exception, match="missing code field"):
        sn.read_snippets(spark, str(tmp_path), ["Python"]).collect()


def test_id_maps(spark, tmp_path):
    pair = tmp_path / "C-Java"
    pair.mkdir()
    (pair / "train-C-map.jsonl").write_text("1-C-1\n\n2-C-1\n")
    (pair / "train-C-Java-tok.c").write_text("x")
    (pair / "test-C-map.jsonl").write_text("3-C-1\n")
    assert {(r.pair, r.language, r.split, r.snippet_id) for r in sn.read_id_maps(spark, str(tmp_path)).collect()} == {("C-Java", "C", "train", "1-1"), ("C-Java", "C", "train", "2-1")}


def test_short_texts(spark, tmp_path):
    spark.createDataFrame([("hello there", "3"), ("more text", "joy")], "t string, l string").write.parquet(str(tmp_path / "news"))
    spec = [{"path": str(tmp_path / "news"), "split": "train", "text_field": "t", "label_field": "l"}]
    got = {r.text: (r.text_label, r.text_label_id, r.source_dataset) for r in sn.short_texts(spark, spec).collect()}
    assert got == {"hello there": ("3", 3, "news"), "more text": ("joy", None, "news")}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert sn.load_specs(str(tmp_path / "s.json")) == spec
    (tmp_path / "s.json").write_text("[{}]")
    with pytest.raises(ValueError):
        sn.load_specs(str(tmp_path / "s.json"))


@pytest.mark.parametrize("suffix", [".jsonl", ".parquet", ".arrow", ""])
def test_round_trip(spark, tmp_path, suffix, rows):
    df = spark.createDataFrame([("C", "é", [1.5, 2.0], 1), ("Java", None, None, 2), ("C", "x", [], 3)], "language string, s string, activation array<float>, n bigint").repartition(2)
    path = str(tmp_path / f"t{suffix}")
    tb.write_table(df, path)
    back = tb.read_activations(spark, path).select(df.columns)
    norm = lambda d: sorted((r.language, r.s, r.activation, r.n) for r in d.collect() if r.n != 2)
    assert norm(back) == norm(df) and back.count() == 3
    assert tb.read_table(spark, path, languages=["Java"]).count() == 1
    assert tb.read_table(spark, path, max_rows=0).count() == 0


def test_half_floats_are_widened(spark, tmp_path):
    t = pa.table({"language": ["C"], "activation": pa.array([np.array([0.5, 2.0], np.float16)], pa.list_(pa.float16()))})
    path = str(tmp_path / "h.arrow")
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    assert tb.read_activations(spark, path).first().activation == [0.5, 2.0]


def test_formats_and_errors(spark, tmp_path):
    assert tb.infer_format("x", "arrow") == "arrow" and tb.infer_format("a/b") == "hf"
    with pytest.raises(ValueError):
        tb.infer_format("x.txt")
    spark.range(3).write.parquet(str(tmp_path / "r.parquet"))
    with pytest.raises(ValueError):
        tb.read_activations(spark, str(tmp_path / "r.parquet"))


def test_counts_and_saves(spark, tmp_path):
    df = spark.createDataFrame([("C", "1", [1, 2]), ("C", "1", None), ("D", "2", [])], "language string, snippet_id string, ids array<long>")
    for suffix in ("pkl", "parquet", "csv"):
        tb.save_frame(df, str(tmp_path / f"t.{suffix}"))
        assert tb.count_rows(spark, [str(tmp_path / "none.pkl"), str(tmp_path / f"t.{suffix}")]) == 3
    assert tb.count_rows(spark, [], 7) == 7 and tb.count_rows(spark, []) is None
    assert isinstance(pd.read_pickle(tmp_path / "t.pkl"), pd.DataFrame)
    summary = tb.run_summary(df)
    assert (summary["num_rows"], summary["num_snippets"], summary["languages"]) == (3, 2, ["C", "D"])
    tb.write_metadata(str(tmp_path / "t.parquet"), summary, layer=3)
    assert tb.read_metadata(str(tmp_path / "t.parquet"))["layer"] == 3 and tb.read_metadata(str(tmp_path / "none")) == {}
    filled = tb.with_metadata(df.limit(1), {"layer": 3, "model_name": "m"})
    assert (filled.first().layer, filled.first().model_name, filled.first().hook_name) == (3, "m", None)
    seen, counts = tb.observed(df.withColumn("error", df.language))
    seen.collect()
    assert counts.get == {"n_rows": 3, "n_failed": 3}


def test_descriptions(spark, tmp_path):
    (tmp_path / "explanations-m").mkdir()
    (tmp_path / "explanations-m" / "a.jsonl").write_text('{"index": "5", "description": "five"}\n{"index": "6", "description": "six"}\n')
    assert [r.description for r in tb.describe_feature(spark, 5, ["m"], str(tmp_path)).collect()] == ["five"]


def test_stream(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    row = lambda i, code: (str(i), str(i), code, "Python", "f", [str(i)], ["f"], 1)
    schema = "snippet_id string, global_idx string, code string, language string, file_path string, source_snippet_ids array<string>, source_file_paths array<string>, num_fragments bigint"
    for i, code in enumerate(["x = 1", "def f(): pass", "y = ("]):
        spark.createDataFrame([row(i, code)], schema).coalesce(1).write.mode("append").parquet(source)
        annotate_stream(read_snippet_stream(spark, source), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert {r.snippet_id for r in got.select("snippet_id").distinct().collect()} == {"0", "1", "2"}
    assert got.count() == got.select("snippet_id", "token_pos").distinct().count()
    query = status_counts(read_snippet_stream(spark, source)).writeStream.format("memory").queryName("statuses").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.status, r.n) for r in spark.table("statuses").collect()} == {("ok", 2), ("parsed_with_errors", 1)}
    assert len(pq.read_schema(next(tmp_path.glob("out/batch=0/*.parquet")))) == 42


@pytest.mark.parametrize("suffix", [".arrow", ""])
def test_overwriting_leaves_nothing_behind(spark, tmp_path, suffix):
    path = str(tmp_path / f"t{suffix}")
    for n, parts in ((40, 4), (3, 1)):
        tb.write_table(spark.range(n).repartition(parts), path)
        assert tb.read_table(spark, path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == [f"t{suffix}"]


def test_saved_dataset_names_its_files_and_columns(spark, tmp_path):
    path = tmp_path / "set"
    tb.write_table(spark.createDataFrame([("a", [1, 2], 0.5, True)], "s string, i array<long>, x double, b boolean"), str(path))
    state, info = (json.loads((path / f"{n}.json").read_text()) for n in ("state", "dataset_info"))
    assert info["features"]["i"] == {"feature": {"dtype": "int64", "_type": "Value"}, "_type": "Sequence"} and info["features"]["x"]["dtype"] == "float64"
    for f in state["_data_files"]:
        with pa.memory_map(str(path / f["filename"])) as source:
            assert pa.ipc.open_stream(source).read_all().column_names == ["s", "i", "x", "b"]


def test_snippet_files(spark, tmp_path):
    data = [("1-Py-1", "Python", "old", "b", 1), ("1-Py-1", "Python", "x = 'é'", "b", 2), ("2-Py-1", "Python", None, "b", 1), ("1-C-1", "C", "int x;", "b", 1), (None, "C", "lost", "b", 1)]
    df = spark.createDataFrame(data, "idx string, language string, code string, bpe string, n long")
    out = tmp_path / "out"
    assert sn.write_snippet_files(df, str(out), ["n"]) == 4
    files = {str(p.relative_to(out)): json.loads(p.read_text()) for p in out.rglob("*.json")}
    assert files == {"Python/1-1.json": {"idx": "1-Py-1", "code": "x = 'é'"}, "Python/2-1.json": {"idx": "2-Py-1", "code": None}, "C/1-1.json": {"idx": "1-C-1", "code": "int x;"}}
    back = {(r.language, r.code) for r in sn.read_snippets(spark, str(out), ["C"]).collect()}
    assert back == {("C", "int x;")}


def test_all_keys_of_snippets(spark, tmp_path):
    (tmp_path / "C").mkdir()
    (tmp_path / "C" / "1-C-1.json").write_text(json.dumps({"idx": "1-C-1", "code": "x", "stars": 3, "language": "no"}))
    r = sn.read_snippets(spark, str(tmp_path), all_keys=True).first()
    assert (r.stars, r.language, r.code) == (3, "C", "x")


def test_labelled_short_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(" a text that is long enough ", 1), ("short", 0), ("another text of some length", 7)], "t string, l long").write.parquet(str(tmp_path / "news"))
    spec = [{"path": str(tmp_path / "news"), "split": "train", "text_field": "t", "label_field": "l", "label_names": ["no", "yes"]}]
    rows = sn.labelled_short_texts(spark, spec, 0, F.size(F.split("text", " "))).collect()
    assert {(r.text, r.text_label, r.text_label_id, r.n_tokens) for r in rows} == {("a text that is long enough", "yes", 1, 6), ("another text of some length", None, 7, 5)}
    assert sn.labelled_short_texts(spark, spec, 1, F.size(F.split("text", " "))).count() == 1
    assert [s["path"] for s in sn.default_specs("/d/")][:2] == ["/d/ag_news", "/d/glue-sst2"]
