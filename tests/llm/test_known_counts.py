"""Known token counts of p5_tokens: several sequences of a snippet, and token rows without a language."""

from tokenloom.llm.queries import p5_documents, p5_tokens, p8_ids


def test_sequences_of_a_snippet_add_up(spark, tmp_path):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("documents", [(1, "a b", "en", "s", "code")], "doc_id long, text string, lang string, source string, domain string")
    write("text_samples", [("t", "x y", "text", "d", 1)], "idx string, text string, language string, source_dataset string, written_at long")
    write("text_token_features", [("t", 2), ("t", 2), ("t", None)], "idx string, seq_len long")
    snippets = [("Python", "s1"), ("Python", "s1"), ("C", "s1"), ("C", "s2"), ("Java", "s3"), (None, "s4")]
    write("snippets", [(l, s, "x = 1", i) for i, (l, s) in enumerate(snippets)], "language string, snippet_id string, code string, written_at long")
    tokens = [
        ("a", "Python", "s1", 10), ("a", "Python", "s1", 10), ("b", "Python", "s1", 7),  # two sequences
        ("c", None, "s2", 5), ("c", None, "s2", 5),  # no language, one snippet has the id
        ("d", None, "s1", 99),  # no language, two snippets have it
        ("e", "Java", "s3", None), ("e", None, "s3", 4),  # the language stands in another row
        ("f", None, "s4", 3), ("g", "Java", "s3", None),
    ]
    write("token_features", tokens, "idx string, language string, snippet_id string, seq_len long")
    got = {(r.table_name, r.language): (r.n_texts, r.n_known, r.known_tokens) for r in p5_tokens(spark, str(tmp_path)).collect()}
    assert got == {
        ("documents", "en"): (1, 0, 0), ("text_samples", "text"): (1, 1, 2), ("snippets", "Python"): (1, 1, 17),
        ("snippets", "C"): (2, 1, 5), ("snippets", "Java"): (1, 1, 4), ("snippets", None): (1, 1, 3),
    }


def test_documents_have_as_many_tokens_as_ids(spark):
    directory = "/root/testdata/sf0.001"
    ids = {str(r.doc_id): r.n for r in p8_ids(spark, directory).selectExpr("doc_id", "size(ids) n").collect()}
    rows = p5_documents(spark, directory).collect()
    assert {r.text_id: r.n_tokens for r in rows if r.table_name == "documents"} == ids
    assert len({(r.table_name, r.language, r.text_id) for r in rows}) == len(rows)
