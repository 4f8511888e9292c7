"""The queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    # Every page's article is one element without attributes; its blocks are headings and paragraphs.
    "op2_tag_ratio_text": r"""
        WITH found AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
        blocks AS (
            SELECT page_id, url, list_filter(list_transform(
                string_split(regexp_replace(regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)),
                lambda b: trim(regexp_replace(replace(replace(replace(regexp_replace(b, '&amp;?', '&', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))),
                lambda b: b <> '') AS lines
            FROM found),
        texts AS (SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text FROM blocks)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
    """,
    # Windows of 20 words with the first place of each sequence; a word goes if one of the last 20 starts repeats.
    "op6_prefix_suffix_trees": r"""
        WITH split AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS k FROM split WHERE len(words) >= 20),
        windows AS (SELECT doc_id, k, array_to_string(words[k : k + 19], ' ') AS path FROM starts),
        ranked AS (SELECT doc_id, k, row_number() OVER (PARTITION BY path ORDER BY doc_id, k) AS leaf FROM windows),
        flagged AS (SELECT doc_id, k FROM ranked WHERE leaf > 1),
        every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split),
        covered AS (
            SELECT e.doc_id, e.word, e.k, max(CASE WHEN f.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.doc_id ORDER BY e.k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
            FROM every e LEFT JOIN flagged f ON e.doc_id = f.doc_id AND e.k = f.k),
        kept AS (
            SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0), '') AS text FROM covered GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
    """,
}
