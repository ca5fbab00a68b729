"""Queries on token rows: texts to tokens, labels, votes, windows, spans, ingest and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import ids, labels, spans
from tokenloom.operators import ingest, tokens, windows
from tokenloom.session import table


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Text samples, each once."""
    return table(spark, d, "text_samples").groupBy("idx").agg(F.max(F.struct("text", "source_dataset")).alias("r")).select("idx", "r.text", "r.source_dataset")


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Token positions, each once, with what the queries on order and spans need."""
    columns = ["idx", "token_pos", "token_text", "char_start", "char_end", "pygments_type", "pygments_simple_type"]
    return table(spark, d, "token_features").select(*columns).distinct()


def text_token_summary(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.text_tokens(table(spark, d, "documents"), ["doc_id"], "text")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum("char_start").alias("sum_start"), F.max("char_end").alias("n_chars"))


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.text_tokens(_samples(spark, d), ["idx"], "text")
    return found.select("idx", F.col("token_pos").cast("long").alias("token_pos"), "token_text", "char_start", "char_end")


def bos_inserted(spark: SparkSession, d: str) -> DataFrame:
    texts = _samples(spark, d)
    out = tokens.insert_bos(tokens.text_tokens(texts, ["idx"], "text"), texts, ["idx"])
    return out.select("idx", F.col("token_pos").cast("long").alias("token_pos"), "token_text", labels.is_special(F.col("char_start"), F.col("char_end")).alias("is_special"))


def text_labels(spark: SparkSession, d: str) -> DataFrame:
    found = tokens.label_text_tokens(tokens.text_tokens(_samples(spark, d), ["idx"], "text"), exact=True)
    return found.groupBy("label", "label_id").agg(F.count(F.lit(1)).alias("n"), F.sum("char_end").alias("sum_end"))


def text_budget(spark: SparkSession, d: str) -> DataFrame:
    found = ingest.in_length_band(_samples(spark, d), "text").withColumn("n_tokens", F.size(F.regexp_extract_all("text", F.lit(tokens.COVERING_PATTERN), F.lit(0))).cast("long"))
    kept = windows.token_budget(found.where(F.col("source_dataset").isNotNull()), "source_dataset", "idx", "n_tokens", 5_000, 60)
    return kept.select("idx", "source_dataset", "n_tokens", "running_tokens")


def normalized_ids(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "token_features").select("idx").distinct()
    c = F.col("idx")
    return raw.select(
        "idx", ids.normalize_global_idx(c).alias("global_idx"), ids.normalize_snippet_id(c).alias("snippet_id"), ids.variant_number(c).alias("variant"), ids.group_key(c).alias("group_key")
    )


def fragment_groups(spark: SparkSession, d: str) -> DataFrame:
    """Tokens as fragments of their sequence: grouping puts the text together again."""
    rows = table(spark, d, "token_features").where(F.col("language").isNotNull()).select(F.concat_ws("-", "idx", "token_pos").alias("idx"), "language", F.lit("t").alias("file_path"), F.col("token_text").alias("code")).distinct()
    return ingest.combine_fragments(rows).select("snippet_id", "language", "code", "num_fragments", F.get("source_snippet_ids", 0).alias("first_id"))


def common_users(spark: SparkSession, d: str) -> DataFrame:
    return ingest.common_ids(table(spark, d, "events"), "user_id", ["event_type"])


def parallel_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snippets").where(F.col("language").isin("Java", "Python", "Javascript"))
    both = ingest.common_ids(rows.where(F.col("language").isin("Java", "Python")), "snippet_id", ["language"])
    return ingest.keep_common(rows, both, "snippet_id").select("language", "snippet_id").distinct()


def latest_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snippets").select("language", "snippet_id", "file_path", "written_at", F.length("code").cast("long").alias("n_chars"))
    return ingest.last_wins(rows, ["language", "snippet_id"], ["written_at", "file_path", "n_chars"]).drop("written_at")


def snippet_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snippets").select("language", "snippet_id").distinct()
    return windows.skip_and_limit(rows, ["language", "snippet_id"], 20, 30)


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_features").select("idx", "global_idx", "language", "token_pos", "token_str")
    return windows.add_neighbor_tokens(rows).drop("global_idx", "language")


def prev_next(spark: SparkSession, d: str) -> DataFrame:
    return windows.previous_and_next(_positions(spark, d).select("idx", "token_pos", "token_text"), ["idx"], ["token_pos"], "token_text")


def last_write(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    place = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = rows.withColumn("pos", F.row_number().over(place).cast("long"))
    write = windows.last_write_before(numbered, ["user_id"], "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("pos"))
    out = numbered.withColumn("last_write_pos", write).withColumn("distance", F.col("pos") - F.col("last_write_pos"))
    return out.select("event_id", "user_id", "pos", "last_write_pos", "distance")


def _blocks(rows: DataFrame) -> DataFrame:
    """Nested blocks of 32 and 8 tokens as scopes, one array per sequence."""
    order = lambda k: F.floor(F.col("token_pos") / k).cast("long")
    block = lambda k, depth: rows.groupBy("idx", order(k).alias("b")).agg(F.min("char_start").alias("start"), F.max("char_end").alias("end")).withColumn("depth", F.lit(depth))
    root = rows.groupBy("idx").agg(F.min("char_start").alias("start"), F.max("char_end").alias("end")).select("idx", F.lit(0).cast("long").alias("b"), "start", "end", F.lit(0).alias("depth"))
    all_blocks = root.unionByName(block(32, 1)).unionByName(block(8, 2))
    return all_blocks.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("depth", "b", "start", "end"))).alias("scopes"))


def scope_at_token(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d)
    found = rows.join(_blocks(rows), "idx").withColumn("s", spans.innermost_scope(F.col("scopes"), F.col("char_start")))
    return found.select("idx", "token_pos", F.col("s.depth").cast("long").alias("depth"), F.col("s.b").alias("block"))


def span_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label runs of a sequence under tokens of five characters."""
    rows = _positions(spark, d).where((F.col("char_end") > F.col("char_start")) & F.col("pygments_simple_type").isNotNull())
    runs = rows.groupBy("idx").agg(
        F.array_sort(F.collect_list(F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("pygments_simple_type").alias("label")))).alias("runs"),
        F.max("char_end").alias("n"),
    )
    cut = runs.select("idx", "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 5))).alias("piece"))
    under = spans.run_labels(F.col("runs"), F.col("piece") * 5, F.col("piece") * 5 + 5)
    return cut.select("idx", "piece", labels.select_code_label(under).alias("label"), F.size(under).cast("long").alias("n_chars"))


def char_places(spark: SparkSession, d: str) -> DataFrame:
    """Of every seventh character of a sequence: the token that holds it, and the first keyword token around it."""
    rows = _positions(spark, d)
    gathered = rows.groupBy("idx").agg(
        F.array_sort(F.collect_list(F.struct("token_pos", F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.coalesce("pygments_simple_type", F.lit("")).alias("name")))).alias("t"), F.max("char_end").alias("n")
    )
    at = gathered.select("idx", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 7))).alias("k")).withColumn("place", F.col("k") * 7)
    near = spans.covering(F.col("t"), F.lit("keyword"), F.col("place") - 3, F.col("place") + 3)
    labels_ = labels.select_tree_label(F.transform(F.filter("t", lambda x: (x["start"] <= F.col("place")) & (F.col("place") < x["end"])), lambda x: x["name"]))
    return at.select("idx", "place", F.get("t", spans.token_at_char(F.col("t"), F.col("place")).cast("int"))["token_pos"].alias("token_pos"), near["token_pos"].alias("keyword_pos"), labels_.alias("label"))


def visible_names(spark: SparkSession, d: str) -> DataFrame:
    """Names visible at each token: variables in blocks of 8 tokens, functions in blocks of 32, classes everywhere."""
    rows = _positions(spark, d)
    kind = F.col("pygments_simple_type")
    depth = F.when(kind == "variable", 2).when(kind == "function", 1).when(kind == "class", 0)
    scope = lambda depth_, pos: F.concat_ws(":", depth_, F.when(depth_ == 2, F.floor(pos / 8)).when(depth_ == 1, F.floor(pos / 32)).otherwise(F.lit(0)))
    declared = (
        rows.where(depth.isNotNull())
        .groupBy("idx")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("token_pos").alias("p"), scope(depth, F.col("token_pos")).alias("scope_id"), depth.alias("depth"), F.col("token_text").alias("name"), F.col("char_start").alias("start"), F.col("char_end").alias("end"))
                )
            ).alias("declarations")
        )
    )
    pos = F.col("token_pos")
    here = F.struct(F.array(scope(F.lit(2), pos), scope(F.lit(1), pos), scope(F.lit(0), pos)).alias("ancestors"))
    seen = spans.visible_declarations(F.col("declarations"), F.col("here"), F.col("char_start"))
    out = rows.join(declared, "idx").withColumn("here", here).withColumn("seen", seen)
    return out.select("idx", "token_pos", F.size("seen").cast("long").alias("n"), F.array_join(F.transform("seen", lambda x: x["name"]), "|").alias("names"))


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = _positions(spark, d).where(F.col("pygments_simple_type").isNotNull())
    blocks = rows.groupBy("idx", F.floor(F.col("token_pos") / 16).cast("long").alias("block"))
    return blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "pygments_simple_type"))), lambda x: x["pygments_simple_type"]).alias("v"))


def vote_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("idx", "block", labels.vote_first_seen(F.col("v"), F.lit("other")).alias("label"))


def vote_first_reached(spark: SparkSession, d: str) -> DataFrame:
    return _sequences(spark, d).select("idx", "block", labels.vote_first_reached(F.col("v"), F.lit("other")).alias("label"))


def simplified_labels(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "token_features").groupBy("pygments_type").agg(F.count(F.lit(1)).alias("n"))
    simple = labels.simplify_label(F.col("pygments_type"))
    return counts.select("pygments_type", simple.alias("label"), labels.label_id(simple).alias("label_id"), "n")


def token_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_features")
    return rows.select(
        "idx", "token_pos", labels.is_special(F.col("char_start"), F.col("char_end")).alias("is_special"), labels.is_blank_token(F.col("token_text")).alias("is_blank"), (F.col("char_end") - F.col("char_start")).alias("char_len"),
        F.count(F.lit(1)).over(Window.partitionBy("idx")).alias("n_rows"),
    )


def display_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_features").select("token_text").distinct().select("token_text", labels.display_token(F.col("token_text")).alias("shown"))


def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_sets").select("set_id", F.filter(F.coalesce("top_k_feature_ids", F.array().cast("array<bigint>")), lambda x: x.isNotNull()).alias("ids"))
    out = tokens.pad_batches(rows.withColumn("labels", F.col("ids")), ["set_id"], "ids", "labels", 32)
    return out.select("set_id", "batch", "ids", "labels", "attention_mask")


def tokens_with_code(spark: SparkSession, d: str) -> DataFrame:
    """Token rows joined with their snippet and its latest parser run: does the text under the span agree?"""
    rows = table(spark, d, "token_features").where(F.col("language").isNotNull()).select("language", "snippet_id", "idx", "token_pos", "token_text", "char_start", "char_end").distinct()
    code = table(spark, d, "snippets").groupBy("language", "snippet_id").agg(F.max("code").alias("code"))
    runs = table(spark, d, "parse_results").groupBy("language", "snippet_id").agg(F.max(F.struct("parsed_at", "status")).alias("r"))
    joined = rows.join(code, ["language", "snippet_id"]).join(runs, ["language", "snippet_id"], "left")
    same = labels.token_text(F.col("code"), F.col("char_start").cast("int"), F.col("char_end").cast("int")) == F.col("token_text")
    return joined.groupBy("language", F.col("r.status").alias("status")).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(same).alias("n_same"))


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Joins of several tables: customers with and without orders, by nation."""
    t = lambda n: table(spark, d, n)
    orders = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    joined = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.count_if(F.col("n").isNull()).alias("n_without"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.round(F.sum("total"), 2).alias("revenue"))


QUERIES = {
    f.__name__: f
    for f in (
        text_token_summary, text_tokens, bos_inserted, text_labels, text_budget, normalized_ids, fragment_groups, common_users, parallel_snippets, latest_snippets,
        snippet_page, neighbors, prev_next, last_write, scope_at_token, span_labels, char_places, visible_names, vote_first_seen, vote_first_reached, simplified_labels,
        token_flags, display_tokens, padded_batches, tokens_with_code, nation_revenue,
    )
}

_P = r"' ?\p{L}+|\p{N}+|[^\p{L}\p{N}]'"
_SAMPLES = "s AS (SELECT idx, r.text AS text, r.sd AS source_dataset FROM (SELECT idx, max({'text': text, 'sd': source_dataset}) AS r FROM text_samples GROUP BY idx) x)"
_TOK = f"""{_SAMPLES},
    k AS (SELECT idx, unnest(regexp_extract_all(text, {_P})) AS token_text, unnest(range(len(regexp_extract_all(text, {_P})))) AS token_pos FROM s),
    t AS (SELECT idx, token_pos, token_text, sum(length(token_text)) OVER (PARTITION BY idx ORDER BY token_pos)::BIGINT AS char_end FROM k)"""
_POS = "pos AS (SELECT DISTINCT idx, token_pos, token_text, char_start, char_end, pygments_type, pygments_simple_type FROM token_features)"


def shown_sql(t: str) -> str:
    """The visible form of a token."""
    return f"""CASE WHEN {t} IS NULL OR {t} = '' THEN '<empty>'
          WHEN regexp_full_match({t}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+') THEN
            CASE WHEN regexp_matches({t}, '[ \\n\\t]') THEN repeat('\\n', length({t}) - length(replace({t}, chr(10), ''))) || repeat('\\t', length({t}) - length(replace({t}, chr(9), '')))
              || CASE length({t}) - length(replace({t}, ' ', '')) WHEN 0 THEN '' WHEN 1 THEN '<space>' ELSE '<space>x' || (length({t}) - length(replace({t}, ' ', '')))::VARCHAR END
            ELSE '<whitespace>' END
          ELSE replace(replace({t}, chr(10), '\\n'), chr(9), '\\t') END"""


def _vote(tie: str) -> str:
    return f"""
        WITH {_POS}, c AS (SELECT idx, token_pos // 16 AS block, pygments_simple_type AS l, count(*) AS n, min(token_pos) AS lo, max(token_pos) AS hi
                 FROM pos WHERE l IS NOT NULL GROUP BY ALL)
        SELECT idx, block, first(l ORDER BY n DESC, {tie}) AS label FROM c GROUP BY idx, block"""


SQL = {
    "text_token_summary": f"""
        WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, {_P})) AS t, unnest(range(len(regexp_extract_all(text, {_P})))) AS p FROM documents),
        e AS (SELECT doc_id, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY p)::BIGINT AS char_end FROM k)
        SELECT doc_id, count(*) AS n_tokens, sum(char_end - length(t))::BIGINT AS sum_start, max(char_end) AS n_chars FROM e GROUP BY doc_id""",
    "text_tokens": f"WITH {_TOK} SELECT idx, token_pos, token_text, char_end - length(token_text) AS char_start, char_end FROM t",
    "bos_inserted": f"""WITH {_TOK} SELECT idx, token_pos + 1 AS token_pos, token_text, false AS is_special FROM t
        UNION ALL SELECT idx, 0, '<bos>', true FROM s""",
    "text_labels": f"""
        WITH {_TOK}, ch AS (SELECT idx, token_pos, unnest(regexp_extract_all(token_text, '(?s).')) AS c, unnest(range(1, length(token_text) + 1)) AS p FROM t),
        kk AS (SELECT idx, token_pos, p, CASE WHEN regexp_full_match(c, '[\\s\\x1c-\\x1f\\x0b\\x85\\p{{Z}}]') THEN 'whitespace' WHEN regexp_full_match(c, '\\p{{L}}') THEN 'word'
              WHEN regexp_full_match(c, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉①-⑨]') THEN 'number' WHEN regexp_full_match(c, '\\p{{N}}') THEN 'other' ELSE 'punctuation' END AS l FROM ch),
        g AS (SELECT idx, token_pos, l, count(*) AS n, max(p) AS hi, l NOT IN ('whitespace', 'other') AS strong FROM kk GROUP BY ALL),
        w AS (SELECT idx, token_pos, first(l ORDER BY strong DESC, n DESC, hi) AS l, count(*) AS kinds FROM g GROUP BY idx, token_pos),
        z AS (SELECT w.idx, w.token_pos, CASE WHEN kinds > 1 AND l <> 'whitespace' THEN 'mixed' ELSE l END AS label, char_end FROM w JOIN t ON t.idx = w.idx AND t.token_pos = w.token_pos)
        SELECT label, list_position(['special', 'whitespace', 'word', 'number', 'punctuation', 'mixed', 'other'], label)::BIGINT - 1 AS label_id, count(*) AS n, sum(char_end)::BIGINT AS sum_end FROM z GROUP BY label""",
    "text_budget": f"""
        WITH {_SAMPLES},
        b AS (SELECT *, len(regexp_extract_all(text, {_P})) AS n_tokens, CAST('0x' || substr(md5('0:' || idx), 1, 15) AS BIGINT) AS h FROM s
              WHERE source_dataset IS NOT NULL AND length(regexp_replace(text, '^[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+|[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+$', '', 'g')) BETWEEN 12 AND 240),
        c AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY h) AS r FROM b),
        w AS (SELECT *, sum(n_tokens) OVER (ORDER BY source_dataset, h)::BIGINT AS running_tokens FROM c WHERE r <= 60)
        SELECT idx, source_dataset, n_tokens, running_tokens FROM w WHERE running_tokens - n_tokens < 5000""",
    "normalized_ids": """
        SELECT DISTINCT idx, regexp_replace(idx, '-[^-]+-', '-', 'g') AS global_idx, split_part(idx, '-', 1) || '-' || split_part(idx, '-', -1) AS snippet_id,
               coalesce(try_cast(CASE WHEN contains(idx, '-') THEN split_part(idx, '-', -1) END AS BIGINT), 0) AS variant,
               regexp_replace(regexp_replace(idx, '-[^-]+-', '-', 'g'), '-[^-]*$', '') AS group_key FROM token_features""",
    "fragment_groups": """
        SELECT regexp_replace(regexp_replace(i, '-[^-]+-', '-', 'g'), '-[^-]*$', '') AS snippet_id, language, string_agg(coalesce(t, ''), '' ORDER BY p, i) AS code, count(*) AS num_fragments,
               first(i ORDER BY p, i) AS first_id
        FROM (SELECT DISTINCT idx || '-' || token_pos AS i, language, token_pos AS p, token_text AS t FROM token_features WHERE language IS NOT NULL) x GROUP BY 1, 2""",
    "common_users": """
        SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(DISTINCT coalesce(event_type, '?')) = (SELECT count(DISTINCT coalesce(event_type, '?')) FROM events)""",
    "parallel_snippets": """
        SELECT DISTINCT language, snippet_id FROM snippets WHERE language IN ('Java', 'Python', 'Javascript') AND snippet_id IN (
          SELECT snippet_id FROM snippets WHERE language IN ('Java', 'Python') GROUP BY snippet_id HAVING count(DISTINCT language) = 2)""",
    "latest_snippets": """
        SELECT language, snippet_id, file_path, length(code) AS n_chars FROM snippets
        QUALIFY row_number() OVER (PARTITION BY language, snippet_id ORDER BY written_at DESC, file_path DESC NULLS LAST, length(code) DESC NULLS LAST) = 1""",
    "snippet_page": "SELECT DISTINCT language, snippet_id FROM snippets ORDER BY language, snippet_id LIMIT 30 OFFSET 20",
    "neighbors": """
        WITH o AS (SELECT global_idx, language, token_pos, min(token_str) AS v FROM token_features GROUP BY 1, 2, 3),
        w AS (SELECT *, lag(v, 2) OVER q AS previous_token_str_2, lag(v, 1) OVER q AS previous_token_str_1, lead(v, 1) OVER q AS next_token_str_1, lead(v, 2) OVER q AS next_token_str_2
              FROM o WINDOW q AS (PARTITION BY global_idx, language ORDER BY token_pos))
        SELECT f.idx, f.token_pos, f.token_str, previous_token_str_2, previous_token_str_1, w.next_token_str_1, w.next_token_str_2 FROM token_features f
        LEFT JOIN w ON f.global_idx IS NOT DISTINCT FROM w.global_idx AND f.language IS NOT DISTINCT FROM w.language AND f.token_pos = w.token_pos""",
    "prev_next": f"""WITH {_POS} SELECT idx, token_pos, token_text, lag(token_text) OVER q AS prev_token_text, lead(token_text) OVER q AS next_token_text
        FROM pos WINDOW q AS (PARTITION BY idx ORDER BY token_pos)""",
    "last_write": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
        l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lw FROM n)
        SELECT event_id, user_id, pos, lw AS last_write_pos, pos - lw AS distance FROM l""",
    "scope_at_token": f"""
        WITH {_POS}, sc AS (SELECT idx, 0 AS depth, 0 AS b, min(char_start) AS s, max(char_end) AS e FROM pos GROUP BY idx
          UNION ALL SELECT idx, 1, token_pos // 32, min(char_start), max(char_end) FROM pos GROUP BY idx, token_pos // 32
          UNION ALL SELECT idx, 2, token_pos // 8, min(char_start), max(char_end) FROM pos GROUP BY idx, token_pos // 8)
        SELECT pos.idx, token_pos, depth::BIGINT AS depth, b AS block FROM pos JOIN sc ON sc.idx = pos.idx AND s <= char_start AND char_start <= e
        QUALIFY row_number() OVER (PARTITION BY pos.idx, token_pos ORDER BY depth DESC, e - s, b) = 1""",
    "char_places": f"""
        WITH {_POS}, n AS (SELECT idx, max(char_end) AS n FROM pos GROUP BY idx), p AS (SELECT idx, unnest(range(0, n // 7 + 1)) * 7 AS place FROM n)
        SELECT p.idx, place, coalesce(min(token_pos) FILTER (char_start <= place AND place < char_end), min(token_pos) FILTER (char_end > place AND char_start <> char_end)) AS token_pos,
               min(token_pos) FILTER (pygments_simple_type = 'keyword' AND char_start < place + 3 AND char_end > place - 3) AS keyword_pos,
               CASE WHEN count(*) FILTER (char_start <= place AND place < char_end) = 0 THEN 'special'
                    ELSE coalesce(min(pygments_simple_type) FILTER (char_start <= place AND place < char_end), '') END AS label
        FROM p JOIN pos ON pos.idx = p.idx GROUP BY p.idx, place""",
    "span_labels": f"""
        WITH {_POS}, ch AS (SELECT idx, unnest(range(char_start, char_end)) AS c, char_start AS st, char_end AS en, pygments_simple_type AS l FROM pos WHERE char_end > char_start AND pygments_simple_type IS NOT NULL),
        n AS (SELECT idx, max(en) AS n FROM ch GROUP BY idx), p AS (SELECT idx, unnest(range(0, (n - 1) // 5 + 1)) AS piece FROM n),
        o AS (SELECT idx, c // 5 AS piece, l, row_number() OVER (PARTITION BY idx, c // 5 ORDER BY st, en, l, c) AS seen FROM ch),
        g AS (SELECT idx, piece, l, count(*) AS k, min(seen) AS f, l NOT IN ('whitespace', 'text') AS strong FROM o GROUP BY ALL),
        w AS (SELECT idx, piece, first(l ORDER BY strong DESC, k DESC, f) AS label, sum(k)::BIGINT AS n_chars FROM g GROUP BY idx, piece)
        SELECT p.idx, p.piece, coalesce(w.label, 'special') AS label, coalesce(w.n_chars, 0) AS n_chars FROM p LEFT JOIN w ON w.idx = p.idx AND w.piece = p.piece""",
    "visible_names": f"""
        WITH {_POS}, dc AS (SELECT idx, token_pos AS p, token_text AS name, char_start AS s, char_end AS e,
                 CASE pygments_simple_type WHEN 'variable' THEN 2 WHEN 'function' THEN 1 ELSE 0 END AS depth FROM pos WHERE pygments_simple_type IN ('variable', 'function', 'class')),
        t AS (SELECT * FROM pos WHERE idx IN (SELECT idx FROM dc)),
        v AS (SELECT t.idx, t.token_pos, dc.* EXCLUDE (idx) FROM t JOIN dc ON dc.idx = t.idx AND dc.e <= t.char_start
              AND (depth = 0 OR (depth = 1 AND dc.p // 32 = t.token_pos // 32) OR (depth = 2 AND dc.p // 8 = t.token_pos // 8))
              QUALIFY row_number() OVER (PARTITION BY t.idx, t.token_pos, name ORDER BY depth DESC, s DESC, p) = 1)
        SELECT t.idx, t.token_pos, count(v.p) AS n, coalesce(string_agg(v.name, '|' ORDER BY depth DESC, s, name), '') AS names
        FROM t LEFT JOIN v ON v.idx = t.idx AND v.token_pos = t.token_pos GROUP BY t.idx, t.token_pos""",
    "vote_first_seen": _vote("lo"),
    "vote_first_reached": _vote("hi"),
    "simplified_labels": "SELECT pygments_type, l AS label, list_position(["
    + ", ".join(f"'{x}'" for x in labels.CODE_LABELS)
    + "], l)::BIGINT - 1 AS label_id, n FROM (SELECT pygments_type, count(*) AS n, CASE "
    + " ".join(f"WHEN starts_with(pygments_type, '{p}') THEN '{labels.LEXER_PREFIXES[p]}'" for p in sorted(labels.LEXER_PREFIXES, key=len, reverse=True))
    + " ELSE 'other' END AS l FROM token_features GROUP BY pygments_type) x",
    "token_flags": """
        SELECT idx, token_pos, char_start = char_end AS is_special, coalesce(regexp_full_match(token_text, '[\\s\\x1c-\\x1f\\x85\\p{Z}]+'), false) AS is_blank, char_end - char_start AS char_len,
               count(*) OVER (PARTITION BY idx) AS n_rows FROM token_features""",
    "display_tokens": f"SELECT DISTINCT token_text, {shown_sql('token_text')} AS shown FROM token_features",
    "padded_batches": """
        WITH r AS (SELECT set_id, list_filter(coalesce(top_k_feature_ids, []), lambda x: x IS NOT NULL) AS i, (row_number() OVER (ORDER BY set_id) - 1) // 32 AS batch FROM token_sets),
        m AS (SELECT *, max(len(i)) OVER (PARTITION BY batch) AS w FROM r)
        SELECT set_id, batch, list_concat(i, list_transform(range(w - len(i)), lambda x: 0::BIGINT)) AS ids, list_concat(i, list_transform(range(w - len(i)), lambda x: -100::BIGINT)) AS labels,
               list_concat(list_transform(i, lambda x: 1::BIGINT), list_transform(range(w - len(i)), lambda x: 0::BIGINT)) AS attention_mask FROM m""",
    "tokens_with_code": """
        WITH t AS (SELECT DISTINCT language, snippet_id, idx, token_pos, token_text, char_start, char_end FROM token_features WHERE language IS NOT NULL),
        c AS (SELECT language, snippet_id, max(code) AS code FROM snippets GROUP BY 1, 2),
        r AS (SELECT language, snippet_id, status FROM parse_results QUALIFY row_number() OVER (PARTITION BY language, snippet_id ORDER BY parsed_at DESC, status DESC NULLS LAST) = 1)
        SELECT t.language, r.status, count(*) AS n_tokens, count(*) FILTER (CASE WHEN char_start = char_end THEN '' ELSE substr(code, char_start + 1, char_end - char_start) END = token_text) AS n_same
        FROM t JOIN c ON c.language = t.language AND c.snippet_id = t.snippet_id LEFT JOIN r ON r.language = t.language AND r.snippet_id = t.snippet_id GROUP BY 1, 2""",
    "nation_revenue": """
        WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
        SELECT n_name, count(*) AS n_customers, count(*) FILTER (n IS NULL) AS n_without, coalesce(sum(n), 0)::BIGINT AS n_orders, round(sum(total), 2) AS revenue
        FROM customer LEFT JOIN o ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
}
