"""Operators on token tables: order, sets, ingest, annotation, encoding, with the awkward cases."""

import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import labels
from tokenloom.functions.tokenizers import PatternTokenizer
from tokenloom.operators import feature_sets, feature_stats, ingest, tokens, windows
from tokenloom.operators.annotate import COLUMNS, annotate_tokens, parse_snippets
from tokenloom.operators.encode import EncoderFile, SeededProvider, encode_features, extract_activations, failed_snippets, feature_on_snippet, good_rows, hook_name, with_sequence_columns

NAN = float("nan")
SNIPPET = "snippet_id string, global_idx string, language string, file_path string, source_snippet_ids array<string>, source_file_paths array<string>, num_fragments bigint, code string"


def snippets(spark, *codes, language="Python"):
    return spark.createDataFrame([(str(i), str(i), language, "f", ["a", "é"], ["p"], 1, c) for i, c in enumerate(codes)], SNIPPET)


# --- order -----------------------------------------------------------------------------------------------------------


def test_neighbors_count_rows_and_reach_duplicates(spark, rows):
    data = [("g", "C", 0, "a"), ("g", "C", 2, "b"), ("g", "C", 2, "b"), ("g", "C", 7, "c"), (None, None, 1, "x"), (None, None, 2, "y")]
    df = spark.createDataFrame(data, "global_idx string, language string, token_pos long, token_str string")
    got = windows.add_neighbor_tokens(df, [-1, 1])
    want = [(*data[0], None, "b"), (*data[1], "a", "c"), (*data[2], "a", "c"), (*data[3], "b", None), (*data[4], None, "y"), (*data[5], "x", None)]
    assert rows(got) == sorted(want, key=repr)
    assert windows.add_neighbor_tokens(df.limit(0)).count() == 0


def test_running_total_and_budget(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("abc"), rng.randrange(0, 20)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, source string, n long").withColumn("h", windows.spread_key(F.col("id")))
    order = sorted(df.collect(), key=lambda r: (r.source, r.h))
    total, want = 0, {}
    for r in order:
        total += r.n
        want[r.id] = total
    assert {r.id: r.t for r in windows.running_total(df, "source", "h", "n", "t").collect()} == want
    kept = windows.token_budget(df.drop("h"), "source", "id", "n", 700, 60).collect()
    chosen, sums, per = [], 0, {}
    for r in order:
        per[r.source] = per.get(r.source, 0) + 1
        if per[r.source] <= 60 and sums < 700:
            chosen.append(r.id)
            sums += r.n
    assert sorted(r.id for r in kept) == sorted(chosen)
    assert windows.token_budget(df.drop("h"), "source", "id", "n", 0).count() == 500
    assert windows.token_budget(df.drop("h").limit(0), "source", "id", "n", 10).count() == 0


def test_last_write_against_a_loop(spark):
    rng = random.Random(3)
    data = [(s, p, rng.choice("xyz"), rng.random() < 0.3) for s in range(5) for p in range(40)]
    df = spark.createDataFrame(data, "s long, p long, k string, w boolean")
    got = {(r.s, r.p): r.lw for r in df.withColumn("lw", windows.last_write_before(df, ["s"], "k", ["p"], F.col("w"), F.col("p"))).collect()}
    for s in range(5):
        last = {}
        for _, p, k, w in (r for r in data if r[0] == s):
            assert got[(s, p)] == last.get(k)
            if w:
                last[k] = p


def test_numbering_and_padding(spark):
    df = spark.createDataFrame([(i, list(range(i % 5)), list(range(i % 5))) for i in range(50)], "id long, ids array<long>, labels array<long>").repartition(7)
    assert {r.id: r.n for r in tokens.number_rows(df, ["id"], "n").collect()} == {i: i for i in range(50)}
    for r in tokens.pad_batches(df, ["id"], "ids", "labels", 4, side="left").collect():
        width = max(i % 5 for i in range(r.batch * 4, min(50, r.batch * 4 + 4)))
        assert r.ids == [0] * (width - r.id % 5) + list(range(r.id % 5))
        assert r.labels[: width - r.id % 5] == [-100] * (width - r.id % 5) and sum(r.attention_mask) == r.id % 5
    assert tokens.pad_batches(df.limit(0), ["id"], "ids", "labels", 4).count() == 0


def test_text_tokens_cover(spark):
    texts = ["a b  c", "", None, "é😀 x1\n", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in tokens.text_tokens(df, ["id"], "text").orderBy("id", "token_pos").collect():
        assert texts[r.id][r.char_start : r.char_end] == r.token_text
        got[r.id] = got.get(r.id, "") + r.token_text
    assert got == {i: t for i, t in enumerate(texts) if t}
    assert tokens.insert_bos(tokens.text_tokens(df, ["id"], "text"), df, ["id"]).where("token_pos = 0").count() == 5


# --- sets and statistics ---------------------------------------------------------------------------------------------


def features(spark, data):
    return spark.createDataFrame(data, "global_idx string, language string, token_str string, top_k_feature_ids array<long>, top_k_feature_activations array<double>")


DATA = [
    ("1", "C", "a", [1, 2, 2], [1.0, 2.0, 3.0]), ("1", "Java", "a", [2], [NAN]), ("2", "C", "", [1, 3], [0.5]), ("3", "Java", None, [], []), ("4", "Java", "b", None, None), ("4", "Java", "b", [9, 1], [4.0, 0.0]), (None, None, "c", [1], [1.0]),
]


def test_discriminative(spark):
    got = {r.feature_id: r for r in feature_stats.discriminative_features(features(spark, DATA), "language", "C").collect()}
    assert set(got) == {1, 2}
    one = got[1]
    assert (one.in_group_count, one.out_group_count, one.in_group_total, one.out_group_total) == (2, 1, 2, 3)
    assert one.lift == pytest.approx(3.0) and one.in_group_mean_activation == pytest.approx(0.75)
    nothing = feature_stats.discriminative_features(features(spark, DATA).where("language = 'C'"), "language", "C").collect()
    assert all(r.lift == float("inf") and np.isnan(r.out_group_rate) for r in nothing)
    empty = feature_stats.discriminative_features(features(spark, DATA).limit(0), "language", "C")
    assert len(empty.columns) == 12 and empty.count() == 0


def test_filters_and_weights(spark):
    df = features(spark, DATA)
    assert feature_stats.filter_by_features(df, [1, 2], match_mode="exact").count() == 1
    assert feature_stats.filter_by_features(df, [9, 3], match_mode="any").count() == 2
    for bad in ({"ids": []}, {"ids": [1], "match_mode": "none"}):
        with pytest.raises(ValueError):
            feature_stats.filter_by_features(df, **bad)
    assert {r.token: r.weight for r in feature_stats.token_weights(df, 1, drop_empty_tokens=False).collect()} == {"a": 1.0, "": 0.5, "b": 0.0, "c": 1.0}
    assert [r.feature_activation for r in feature_stats.rows_with_feature(df, 1).collect()] == [1.0, 1.0, 0.5]
    with pytest.raises(ValueError):
        feature_stats.token_weights(df, 1, weight_mode="none")


def test_pmi(spark):
    df = features(spark, DATA)
    one = feature_stats.pmi_one(df, 2, F.col("language") == "C").first()
    assert (one.n_rows, one.n_feature, one.n_both, one.n_label) == (7, 2, 2, 2)
    every = {r.feature_id: r for r in feature_stats.pmi_all(df, F.col("language") == "C").collect()}
    assert every[2].feature_count == 1 and every[2].feature_activation_mass == 3.0 and every[9].pmi == -float("inf")
    assert feature_stats.pmi_all(df, F.lit(False)).count() == 0
    assert feature_stats.pmi_one(df.limit(0), 2, F.lit(True)).first().n_rows == 0


def test_sets(spark, rows):
    df = features(spark, DATA)
    sets = {(r.language, r.token_str): r.features for r in feature_sets.token_feature_sets(df).collect()}
    assert sets[("C", "a")] == [1, 2] and sets[("Java", None)] == [] and sets[("Java", "b")] == [1, 9] and sets[(None, "c")] == [1]
    assert len(feature_sets.token_feature_sets(df, drop_empty_tokens=True).collect()) == 4
    assert rows(feature_sets.feature_indicators(df)) == sorted([("1", "C", 1), ("1", "C", 2), ("1", "Java", 2), ("2", "C", 1), ("2", "C", 3), ("4", "Java", 9), ("4", "Java", 1)], key=repr)
    with pytest.raises(ValueError):
        feature_sets.token_feature_sets(df, token_col="none")


@pytest.mark.parametrize("mode", ["other_snippets", "all"])
@pytest.mark.parametrize("block", [3, None])
def test_overlap_against_all_pairs(spark, mode, block):
    rng = random.Random(7)
    data = [(str(u), lang, rng.sample(range(300 if u == 3 else 9), 280 if u == 3 else rng.randrange(0, 6))) for u in range(8) for lang in "xyz" if rng.random() < 0.8]
    sums = {}
    for i, (u, a, f) in enumerate(data):
        for v, b, g in data[i + 1 :]:
            if mode == "other_snippets" and u == v:
                continue
            f_, g_ = set(f), set(g)
            s = sums.setdefault(tuple(sorted((a, b))), [0.0, 0])
            s[0] += len(f_ & g_) / len(f_ | g_) if f_ | g_ else 0
            s[1] += 1
    df = spark.createDataFrame([(*d, 1) for d in data] + [("9", None, [1], 1)], "unit string, language string, features array<long>, block int")
    got = {(r.language_1, r.language_2): (r.mean_jaccard, r.n_pairs) for r in feature_sets.overlap_matrix(df, "unit", mode=mode, block=block).collect()}
    assert len(got) == 9
    for (a, b), (mean, n) in got.items():
        total, count = sums.get(tuple(sorted((a, b))), (0, 0))
        assert n == count and (mean == pytest.approx(total / count) if count else np.isnan(mean))
    assert feature_sets.overlap_matrix(df.limit(0), "unit").count() == 0


def test_mean_jaccard_of_two_lists():
    left, right = [[1, 2, 3], [], [4, None, 4]], [[2, 3, 9], []]
    want = [2 / 4, 0, 0, 0, 0, 0]
    assert feature_sets.mean_jaccard(left, right) == pytest.approx(sum(want) / 6)
    assert feature_sets.mean_jaccard([[1, 2], [2, 3], [1, 2]], [], same=True) == pytest.approx((1 / 3 + 1 + 1 / 3) / 3)
    assert np.isnan(feature_sets.mean_jaccard(left, [])) and np.isnan(feature_sets.mean_jaccard([[1]], [], same=True))


@pytest.mark.parametrize("same", [True, False])
def test_overlap_in_bounded_memory(same):
    """100 features in all sets are met 9 million times, some in pairs of sets and one in a single set; no more memory for that."""
    sets = [[*range(100), 1000 + i // 2, 2000 + i] for i in range(300)]
    tracemalloc.start()
    try:
        got = feature_sets.mean_jaccard(sets, [] if same else sets, same)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    pairs = 300 * 299 // 2
    total = (pairs - 150) * 100 / 104 + 150 * 101 / 103
    assert got == pytest.approx(total / pairs if same else (2 * total + 300) / 300**2)
    assert peak < 64e6


@pytest.mark.parametrize("mode", ["other_snippets", "all"])
def test_overlap_of_large_sets(spark, monkeypatch, mode):
    """Blocks are cut by the features of their sets, too; 200 sets of 100,000 features are no block of 160 MB."""
    assert feature_sets.block_count(200, 200 * 100_000) == 10 and feature_sets.block_count(200, 200 * 10) == 1
    assert feature_sets.block_count(2, 10**9) == 2 and feature_sets.block_count(0, 0) == 1 and feature_sets.block_count(10**6, 10**6) == -(-(10**6) // feature_sets.BLOCK_SETS)
    df = spark.createDataFrame([(str(i // 2), "xy"[i % 2], [*range(30), 100 + i]) for i in range(40)] + [("e", "x", []), ("f", "y", None)], "unit string, language string, features array<long>")
    monkeypatch.setattr(feature_sets, "BLOCK_FEATURES", 100)
    got = {(r.language_1, r.language_2): (r.mean_jaccard, r.n_pairs) for r in feature_sets.overlap_matrix(df, "unit", mode=mode).collect()}
    within, across = 210, 21 * 21 - 20 * (mode == "other_snippets")
    full = 400 - 20 * (mode == "other_snippets")
    assert {k: n for k, (_, n) in got.items()} == {("x", "x"): within, ("y", "y"): within, ("x", "y"): across, ("y", "x"): across}
    assert got["x", "x"][0] == got["y", "y"][0] == pytest.approx(190 * 30 / 32 / within) and got["x", "y"][0] == got["y", "x"][0] == pytest.approx(full * 30 / 32 / across)


# --- ingest ----------------------------------------------------------------------------------------------------------


def test_fragments(spark):
    data = [("7-Py-2", "Python", "b", "B"), ("7-Py-10", "Python", "a", "J"), ("7-Py-1", "Python", "c", None), ("x", "C", None, "only"), ("7-C-1", "C", "d", "C")]
    got = {(r.language, r.snippet_id): r for r in ingest.combine_fragments(spark.createDataFrame(data, "idx string, language string, file_path string, code string"), "|").collect()}
    r = got[("Python", "7")]
    assert (r.code, r.num_fragments, r.file_path, r.source_snippet_ids) == ("|B|J", 3, "c", ["7-Py-1", "7-Py-2", "7-Py-10"])
    assert got[("C", "x")].code == "only" and len(got) == 3


def test_common_ids(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), (None, "y"), ("c", "y")], "id string, s string")
    assert rows(ingest.common_ids(df, "id", ["s"])) == [("a",)]
    assert ingest.common_ids(df.limit(0), "id", ["s"]).count() == 0
    assert rows(ingest.last_wins(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, None, "z")], "k int, o int, v string"), ["k"], ["o"])) == [(1, 2, "y"), (2, None, "z")]
    assert windows.skip_and_limit(df, ["id", "s"], 1, 0).count() == 0


# --- annotation ------------------------------------------------------------------------------------------------------

CODE = "def f(a, b):\n    max_size = a\n    max_size += b\n    return max_size\n"


def test_annotation(spark):
    out = annotate_tokens(snippets(spark, CODE, "", None, "x = (", "é = '😀'\n"))
    assert out.columns == COLUMNS and len(COLUMNS) == 42
    got = out.orderBy("snippet_id", "token_pos").collect()
    first = [r for r in got if r.snippet_id == "0"]
    assert "".join(r.token_text for r in first) == CODE
    assert json.loads(first[0].source_snippet_ids) == ["a", "é"] and first[0].source_snippet_ids == '["a", "é"]'
    named = [(r.token_text, r.token_variable_access_kind, r.token_name_is_decl, r.token_name_declaration_token_pos, r.token_name_last_write_token_pos) for r in first if r.token_identifier_name == "max_size"]
    # Three tokens make the name; the write counts from its last token on.
    assert named[0] == (" max", "write", True, first.index(next(r for r in first if r.token_text == " max")), None)
    begin = named[0][3]
    assert [n[0] for n in named[:3]] == [" max", "_", "size"] and {n[4] for n in named[:3]} == {None}
    assert {n[4] for n in named[3:6]} == {begin + 2} and {n[1] for n in named[3:6]} == {"read_write"}
    assert named[-1][4] > begin + 5
    assert {r.tree_sitter_status for r in got if r.snippet_id == "3"} == {"parsed_with_errors"}
    assert not [r for r in got if r.snippet_id in ("1", "2")]
    assert [r.token_text for r in got if r.snippet_id == "4"][:1] == ["é"]
    assert annotate_tokens(snippets(spark, CODE).limit(0)).count() == 0


def test_failures_are_rows(spark):
    parsed = parse_snippets(snippets(spark, "x", language="no such language")).first()
    assert parsed.status == "error" and parsed.error and len(parsed.tokens) == 1
    assert [r.scope_node_type for r in annotate_tokens(snippets(spark, "int x;", language="C")).collect()][0] == "root"


def test_special_tokens_with_a_file(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    fast = Tokenizer(models.WordLevel({"<s>": 0, "x": 1, "?": 2}, unk_token="?"))
    fast.pre_tokenizer = pre_tokenizers.Whitespace()
    fast.post_processor = processors.TemplateProcessing(single="<s> $A", special_tokens=[("<s>", 0)])
    import tempfile

    from tokenloom.functions.tokenizers import FileTokenizer

    path = tempfile.mkdtemp() + "/t.json"
    fast.save(path)
    got = annotate_tokens(snippets(spark, "x y"), FileTokenizer(path, add_special_tokens=True)).orderBy("token_pos").collect()
    assert [(r.token_text, r.pygments_simple_label, r.is_name_like_token) for r in got][0] == ("", "special", False)
    assert [r.token_text for r in got] == ["", "x", "y"]


# --- encoding --------------------------------------------------------------------------------------------------------


def test_encoding(spark, tmp_path):
    rng = np.random.default_rng(0)
    w, b = rng.standard_normal((8, 32)).astype(np.float32), rng.standard_normal(32).astype(np.float32)
    np.savez(tmp_path / "w.npz", w=w, b=b)
    texts = snippets(spark, "a b c", "one two three four five", "")
    dense = extract_activations(texts, SeededProvider(8), "m", 3, max_context=4)
    assert [r.error for r in failed_snippets(dense).collect()] == ["5 tokens exceed the context of 4"]
    assert good_rows(extract_activations(texts, SeededProvider(8), "m", 3, max_context=4, truncate=True)).count() == 7
    out = with_sequence_columns(encode_features(good_rows(dense), EncoderFile(str(tmp_path / "w.npz")), "r", "i", top_k=3, thresholds=[0.0, 0.5]))
    got = out.orderBy("token_pos").collect()
    provider, found = SeededProvider(8), PatternTokenizer().encode("a b c")
    z = np.maximum(provider([t.token_id for t in found]) @ w + b, 0)
    for r, row in zip(got, z):
        want = sorted(range(32), key=lambda i: (-row[i], i))[:3]
        assert r.top_k_feature_ids == [i for i in want if row[i] > 0]
        assert r.top_k_feature_activations == pytest.approx([float(row[i]) for i in r.top_k_feature_ids], rel=1e-5)
        assert (r.sae_active_ge_0_5, r.top_1_feature_id, r.hook_name) == (int((row >= 0.5).sum()), want[0], "blocks.3.hook_resid_post")
    assert [r.prev_token_str for r in got] == [None, "a", " b"] and {r.seq_len for r in got} == {3}
    view = feature_on_snippet(out, "0", "Python", got[0].top_1_feature_id).collect()
    assert view[0].value == pytest.approx(got[0].top_1_feature_activation)
    with pytest.raises(ValueError):
        feature_on_snippet(out, "nope", "Python", 1)
    with pytest.raises(ValueError):
        hook_name(1, "none")


def test_labels_of_tokens(spark):
    df = tokens.text_tokens(spark.createDataFrame([(1, "the 12 ²½!")], "id long, text string"), ["id"], "text")
    exact = {r.token_text: r.label for r in tokens.label_text_tokens(df, exact=True).collect()}
    assert exact == {"the": "word", " ": "whitespace", "12": "number", "²½": "mixed", "!": "punctuation"}
    assert labels.TEXT_LABELS.index("mixed") == 5


def test_vectors_that_do_not_fit(spark, tmp_path):
    np.savez(tmp_path / "w.npz", w=np.eye(3, dtype=np.float32), b=np.zeros(3, np.float32))
    data = [("s", "C", 0, "a", [1.0, 2.0, 0.0]), ("s", "C", 1, "b", [1.0]), ("s", "C", 2, "c", [1.0, None, 2.0]), ("s", "C", 3, "d", None)]
    df = spark.createDataFrame(data, "snippet_id string, language string, token_pos long, token_text string, activation array<float>").withColumn("char_start", F.lit(0)).withColumn("char_end", F.lit(1))
    out = encode_features(df, EncoderFile(str(tmp_path / "w.npz")), "r", "i", top_k=2, metadata={"model_name": "m"}, isolate=True)
    got = {r.token_pos: (r.error is None, r.top_k_feature_ids, r.top_k_found, r.model_name) for r in out.collect()}
    assert got == {0: (True, [1, 0], 2, "m"), 1: (False, None, None, "m"), 2: (False, None, None, "m")}
    with pytest.raises(Exception, match="no 3 numbers"):
        encode_features(df, EncoderFile(str(tmp_path / "w.npz")), "r", "i", top_k=2).collect()


def test_failures_can_fail_the_query(spark):
    with pytest.raises(Exception, match="no parser"):
        annotate_tokens(snippets(spark, "int x;", language="C"), fail_on_error=True).collect()


class _Failing(PatternTokenizer):
    def encode(self, text):
        if "!" in text:
            raise ValueError("no tokens for this")
        return super().encode(text)


def test_a_failing_tokenizer_is_a_status():
    from tokenloom.functions.syntax import ParserRegistry
    from tokenloom.operators.annotate import parse_snippet

    got = parse_snippet("a!", "Python", _Failing(), ParserRegistry())
    assert (got["status"], got["error"], got["tokens"]) == ("error", "no tokens for this", [])
    assert parse_snippet("a", "Python", _Failing(), ParserRegistry())["status"] == "ok"


def test_legacy_rows(spark, tmp_path):
    from tokenloom.operators.legacy import code_feature_rows, text_feature_rows

    np.savez(tmp_path / "w.npz", w=np.eye(4, dtype=np.float32), b=np.zeros(4, np.float32))
    encoder = EncoderFile(str(tmp_path / "w.npz"))
    code = spark.createDataFrame([("1", "Python", "def f(x): return  12", "what"), ("2", "Python", None, None)], "idx string, language string, code string, comment string")
    rows = code_feature_rows(code, SeededProvider(4), encoder, "m", 3, "r", "i", max_length=6, top_k=2, include_code=True).orderBy("token_pos").collect()
    assert [(r.token_str, r.pygments_simple_type) for r in rows] == [("def", "keyword"), (" f", "function"), ("(", "punctuation"), ("x", "name"), (")", "punctuation"), (":", "punctuation")]
    assert {(r.seq_len, r.code_char_len, r.comment, r.problem_desc, r.code) for r in rows} == {(6, 20, "what", None, "def f(x): return  12")}
    assert (rows[0].prev_token_str, rows[0].next_token_str, rows[5].next_token_str, rows[1].pygments_type) == (None, " f", None, "Token.Name.Function")
    text = spark.createDataFrame([("t", "the 12!", "news", 3)], "idx string, text string, source_dataset string, text_label_id long")
    rows = text_feature_rows(text, SeededProvider(4), encoder, "m", 3, "r", "i", top_k=2).orderBy("token_pos").collect()
    assert [(r.token_text, r.pygments_simple_type, r.pygments_type) for r in rows] == [("the", "word", "Text.Word"), (" ", "whitespace", "Text.Whitespace"), ("12", "number", "Text.Number"), ("!", "punctuation", "Text.Punctuation")]
    assert {(r.modality, r.text_char_len, r.source_dataset, r.text_label_id) for r in rows} == {("text", 7, "news", 3)}
