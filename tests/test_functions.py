"""Expressions against direct Python definitions."""

from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import features, ids, labels, spans, syntax
from tokenloom.operators.encode import top_and_stats
from tokenloom.operators.lexing import lexer_runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def column(values, kind="array<string>"):
    return F.array(*[F.lit(v) for v in values]).cast(kind) if values else F.array().cast(kind)


def test_votes_differ_on_ties(spark):
    v = column(["a", "b", "b", "a"])
    assert one(spark, labels.vote_first_seen(v)) == "a"
    assert one(spark, labels.vote_first_reached(v)) == "b"
    assert one(spark, labels.vote_first_seen(column(["", "x"]))) == "x"
    assert one(spark, labels.vote_first_seen(column([]), F.lit("none"))) == "none"


def test_votes_against_counting(spark):
    import random

    rng = random.Random(1)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    got = {r.i: (r.a, r.b) for r in df.select("i", labels.vote_first_seen(F.col("v")).alias("a"), labels.vote_first_reached(F.col("v")).alias("b")).collect()}
    for i, v in enumerate(lists):
        top = max(Counter(v).values())
        seen = next(x for x in v if v.count(x) == top)
        counts, reached = Counter(), None
        for x in v:
            counts[x] += 1
            if counts[x] == top:
                reached = x
                break
        assert got[i] == (seen, reached), v


def test_label_selection(spark):
    cases = {("whitespace", "name", "name"): "name", ("whitespace", "text"): "whitespace", (): "special", ("text", "whitespace", "whitespace"): "whitespace"}
    for chars, want in cases.items():
        assert one(spark, labels.select_code_label(column(list(chars)))) == want
    texts = {(): "special", ("whitespace", "word"): "mixed", ("whitespace",): "whitespace", ("word", "word"): "word", ("word", "number"): "mixed", ("other",): "other"}
    for chars, want in texts.items():
        assert one(spark, labels.select_text_label(column(list(chars)))) == want
    assert one(spark, labels.select_tree_label(column(["", ""]))) == ""
    assert one(spark, labels.select_tree_label(column([]))) == "special"


@pytest.mark.parametrize(("token", "want"), [(" the", "mixed"), ("²", "number"), ("½", "other"), ("😀", "punctuation"), (" ", "whitespace"), ("", "special"), (None, "special"), ("é1", "mixed"), ("--", "punctuation")])
def test_text_labels(spark, token, want):
    df = spark.createDataFrame([(token,)], "t string")
    assert df.select(labels.select_text_label(labels.char_labels_exact("t")).alias("l")).first().l == want


def test_simplify(spark):
    cases = {"Token.Name.Function.Magic": "function", "Token.Name.Exception": "name", "Token.Text.Whitespace": "whitespace", "Token.Error": "other", None: "other", "Token.Literal.String.Doc": "string"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", labels.simplify_label(F.col("t")).alias("s")).collect()} == cases
    assert one(spark, labels.label_id(F.lit("keyword"))) == 2 and one(spark, labels.label_id(F.lit("none"))) is None


def test_display(spark):
    cases = {"": "<empty>", None: "<empty>", " ": "<space>", "   ": "<space>x3", "\n\t ": "\\n\\t<space>", " ": "<whitespace>", "a\n": "a\\n", "x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.s for r in df.select("t", labels.display_token(F.col("t")).alias("s")).collect()} == cases


def test_ids(spark):
    c = F.lit
    assert one(spark, ids.normalize_global_idx(c("1800-Java-1"))) == "1800-1"
    assert one(spark, ids.normalize_global_idx(c("a-b-c-d-e"))) == "a-c-e"
    assert one(spark, ids.normalize_snippet_id(c("a-b-c-d-e"))) == "a-e"
    assert one(spark, ids.normalize_snippet_id(c("x"))) == "x-x"
    assert [one(spark, ids.variant_number(c(x))) for x in ("a-12", "a", "a-b", "a-")] == [12, 0, 0, 0]
    assert one(spark, ids.group_key(c("1800-Java-1"))) == "1800"
    assert ids.threshold_column(0.1) == "sae_active_ge_0_1" and ids.threshold_column(-2.5) == "sae_active_ge_neg_2_5"


def test_top_pairs(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0, 0.0, float("nan"), None],), ([-1.0],), ([],), (None,)], "v array<double>")
    got = [r.p and [tuple(x) for x in r.p] for r in df.select(features.top_pairs(F.col("v"), 2).alias("p")).collect()]
    assert got == [[(1, 3.0), (2, 3.0)], [], [], None]
    signed = df.select(features.top_pairs(F.col("v"), 9, False).alias("p")).first().p
    assert [x.feature_id for x in signed] == [1, 2, 0, 4, 3]


@given(st.lists(st.lists(st.sampled_from([-1.0, 0.0, 0.5, 1.0, 2.0]), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_top_and_stats(rows, k):
    import numpy as np

    z = np.array(rows, np.float32)
    out = top_and_stats(z, k, True, [0.0, 0.1])
    for row, best in zip(rows, out["ids"]):
        assert best.tolist() == [i for _, i in sorted((-x, i) for i, x in enumerate(row))[: min(k, 6)] if row[i] > 0]
    assert out["sae_active_ge_0_0"] == [sum(x >= 0 for x in r) for r in rows]


def test_feature_lists(spark):
    df = spark.createDataFrame([("[3, 1, 2]", "[0.5, 0.25]", 9), (None, None, None), ("[]", "[]", 4)], "top_k_feature_ids string, top_k_feature_activations string, top_1_feature_id long")
    got = [[tuple(p) for p in r.p] for r in df.select(features.selected_pairs(df, 5).alias("p")).collect()]
    assert got == [[(3, 0.5), (1, 0.25)], [], []]
    wide = df.select("top_1_feature_id")
    assert [r.f for r in wide.select(features.selected_features(wide, 3).alias("f")).collect()] == [[9], [], [4]]
    with pytest.raises(ValueError):
        features.selected_features(spark.range(1), 3)
    with pytest.raises(ValueError):
        features.snippet_column(spark.range(1))


def test_scopes_and_spans(spark):
    scopes = F.array(*[F.struct(F.lit(i).alias("scope_id"), F.lit(d).alias("depth"), F.lit(s).alias("start"), F.lit(e).alias("end")) for i, d, s, e in [(0, 0, 0, 100), (1, 1, 10, 50), (2, 1, 50, 60), (3, 2, 20, 30)]])
    for p, want in [(5, 0), (30, 3), (31, 1), (50, 2), (99, 0), (500, 0)]:
        assert one(spark, spans.innermost_scope(scopes, F.lit(p)))["scope_id"] == want
    tokens = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in [(0, 0), (0, 3), (5, 9)]])
    assert [one(spark, spans.token_at_char(tokens, F.lit(p))) for p in (0, 3, 8, 9)] == [1, 2, 2, None]


CODE = "def f(a, b=2):\n    xs = a\n    xs += b\n    o.p = xs\n    return xs\n"


def test_python_nodes():
    nodes, faulty = syntax.parse_python(CODE)
    found = syntax.analyse(nodes, CODE, "Python")
    assert not faulty
    assert {(d["name"], d["kind"]) for d in found["declarations"]} == {("f", "function"), ("a", "parameter"), ("b", "parameter"), ("xs", "variable"), ("o", "variable"), ("p", "variable")}
    uses = [(u["name"], u["access"]) for u in found["usages"]]
    assert uses == [("f", "read"), ("a", "write"), ("b", "write"), ("xs", "write"), ("a", "read"), ("xs", "read_write"), ("b", "read"), ("o", "read"), ("p", "property"), ("xs", "read"), ("xs", "read")]
    assert all(CODE[n.start : n.end] for n in nodes)
    assert syntax.parse_python("def f(:")[1]


def test_node_rules():
    N = syntax.Node
    code = "a[i]++ x = 1 try e"
    nodes = [
        N(0, None, None, "program", True, 0, 18), N(1, 0, None, "update_expression", True, 0, 6), N(2, 1, None, "identifier", True, 0, 1), N(3, 1, None, "identifier", True, 2, 3),
        N(4, 0, None, "assignment_expression", True, 7, 12), N(5, 4, "left", "variable_name", True, 7, 8), N(6, 4, "right", "number", True, 11, 12), N(7, 0, None, "catch_clause", True, 13, 18), N(8, 7, None, "identifier", True, 17, 18),
    ]
    found = syntax.analyse(nodes, code, "PHP")
    assert [(u["name"], u["access"]) for u in found["usages"]] == [("a", "read_write"), ("i", "read_write"), ("x", "write"), ("e", "read")]
    assert [(d["name"], d["kind"], d["depth"]) for d in found["declarations"]] == [("x", "variable", 0), ("e", "exception_variable", 1)]
    deep = [N(0, None, None, "program", True, 0, 1)] + [N(i, i - 1, None, "block", True, 0, 1) for i in range(1, 3000)]
    assert len(syntax.analyse(deep, "x", "C")["scopes"]) == 3000


def test_registry_keeps_failures():
    calls = []

    def maker():
        calls.append(1)
        raise RuntimeError("no grammar")

    registry = syntax.ParserRegistry({"C": maker})
    for _ in range(2):
        with pytest.raises(RuntimeError):
            registry.get("C")
    assert len(calls) == 1
    with pytest.raises(ValueError):
        registry.get("Cobol")


def test_lexer_runs_cover():
    for code in ("x = 'é'\n", "", "\n\n  def f(): pass"):
        runs = lexer_runs(code, "Python")
        assert "".join(code[r["start"] : r["end"]] for r in runs) == code
    with pytest.raises(ValueError):
        lexer_runs("x", "no such language")
