"""SQL that must give the rows of the queries, where SQL can express them."""

from __future__ import annotations


def _top(n: int, columns: str) -> str:
    return f"""
        SELECT {columns} FROM (
            SELECT *, row_number() OVER (PARTITION BY top_feature_id
                       ORDER BY top_feature_activation DESC, token_str, idx, token_pos) AS rank_no
            FROM (SELECT DISTINCT top_feature_id, top_feature_activation, token_str, idx, token_pos FROM token_features
                  WHERE top_feature_id IS NOT NULL AND top_feature_activation IS NOT NULL
                    AND NOT isnan(top_feature_activation)) t) r
        WHERE rank_no <= {n}"""


_PAIRS = """
    WITH pos AS (SELECT idx, token_pos, max(list_sort(list_distinct(top_k_feature_ids))) AS ids
                 FROM token_features GROUP BY idx, token_pos),
    rec AS (SELECT row_number() OVER () AS r, ids FROM pos WHERE len(ids) > 0),
    item AS (SELECT r, unnest(ids) AS i FROM rec),
    cnt AS (SELECT i, count(*) AS n_i FROM item GROUP BY i),
    tot AS (SELECT count(*) AS n FROM rec),
    pair AS (SELECT a.i AS feature_a, b.i AS feature_b, count(*) AS n_ab
             FROM item a JOIN item b ON a.r = b.r AND a.i < b.i GROUP BY a.i, b.i)
"""

_SETS = """
    WITH sets AS (SELECT set_id, ids FROM (SELECT set_id, list_sort(list_distinct(top_k_feature_ids)) AS ids
                  FROM token_sets) t WHERE len(ids) >= 5)
"""

_SPANS = """
    WITH w AS (SELECT doc_id, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),
    p AS (SELECT doc_id, i, substr(text, i, 200) AS s FROM w),
    hit AS (SELECT doc_id, i FROM p SEMI JOIN (SELECT s FROM p GROUP BY s HAVING min(doc_id) <> max(doc_id)) g USING (s)),
    part AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS gap FROM hit),
    run AS (SELECT doc_id, i, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM part),
    stretch AS (SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 200 AS n_chars FROM run GROUP BY doc_id, k)
"""

SQL = {
    "p1_bound": """
        WITH pos AS (SELECT max(struct_pack(language, pygments_simple_type, sae_l0_positive, sae_max_activation)) AS r FROM token_features GROUP BY idx, token_pos),
        val AS (SELECT r.language AS language, r.pygments_simple_type AS pygments_simple_type, unnest([
                  struct_pack(metric := 'sae_l0_positive', v := r.sae_l0_positive::DOUBLE), struct_pack(metric := 'sae_max_activation', v := r.sae_max_activation)], recursive := true) FROM pos),
        cnt AS (SELECT language, pygments_simple_type, metric, count(*) AS n FROM val WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL)
        SELECT c.*, percentile, true AS within FROM cnt c, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])::DOUBLE AS percentile) p""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_found": _SPANS + "SELECT DISTINCT doc_id FROM hit",
    "p10_stretches": _SPANS + "SELECT doc_id, start AS begin, n_chars FROM stretch",
    "p10_shared": _SPANS
    + """
        SELECT d.doc_id, length(text) AS n_chars, coalesce(n, 0)::BIGINT AS n_shared, coalesce(n / nullif(length(text), 0), 0)::DOUBLE AS share, coalesce(k, 0) AS n_spans
        FROM documents d LEFT JOIN (SELECT doc_id, sum(n_chars) AS n, count(*) AS k FROM stretch GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
    "p3_found": _top(3, "top_feature_id, rank_no, idx, token_pos"),
    "p3_top_tokens": _top(10, "top_feature_id, rank_no, top_feature_activation, token_str, idx, token_pos"),
    "p4_found": _PAIRS
    + """
        SELECT feature_a, feature_b FROM pair, tot, cnt ca, cnt cb
        WHERE ca.i = feature_a AND cb.i = feature_b AND n_ab >= 10 AND n_ab * n >= 10 * ca.n_i * cb.n_i""",
    "p4_pairs": _PAIRS
    + """
        SELECT feature_a, feature_b, n_ab, ca.n_i AS n_a, cb.n_i AS n_b, n,
               round(n_ab * n / (ca.n_i * cb.n_i)::DOUBLE, 6) AS lift,
               round(log2(n_ab * n / (ca.n_i * cb.n_i)::DOUBLE), 6) AS pmi
        FROM pair, tot, cnt ca, cnt cb WHERE ca.i = feature_a AND cb.i = feature_b AND n_ab >= 2""",
    "p6_found": _SETS
    + """
        SELECT a.set_id AS set_id_a, b.set_id AS set_id_b FROM sets a JOIN sets b ON a.set_id < b.set_id
          AND len(a.ids) * 5 >= len(b.ids) * 4 AND len(b.ids) * 5 >= len(a.ids) * 4
        WHERE 5 * len(list_intersect(a.ids, b.ids)) >= 4 * len(list_distinct(list_concat(a.ids, b.ids)))""",
    "p6_links": _SETS
    + """
        , cls AS (SELECT ids, min(set_id) AS class_id, count(*) AS n_copies FROM sets GROUP BY ids),
        link AS (SELECT a.class_id, sum(b.n_copies) AS n_links FROM cls a JOIN cls b ON a.class_id <> b.class_id
          AND len(a.ids) * 5 >= len(b.ids) * 4 AND len(b.ids) * 5 >= len(a.ids) * 4
          WHERE 5 * len(list_intersect(a.ids, b.ids)) >= 4 * len(list_distinct(list_concat(a.ids, b.ids))) GROUP BY 1)
        SELECT s.set_id, c.class_id, c.n_copies, coalesce(l.n_links, 0)::BIGINT AS n_links
        FROM sets s JOIN cls c ON s.ids = c.ids LEFT JOIN link l ON l.class_id = c.class_id""",
}
