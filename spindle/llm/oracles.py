"""DuckDB SQL for the corpus queries that SQL can express."""

SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d),
        g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS h FROM w),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
        c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1) GROUP BY doc_id),
        k AS (
            SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
                   list_filter(ws, lambda x, j: gone IS NULL OR NOT list_contains(gone, j)) AS kept
            FROM d LEFT JOIN c ON c.doc_id = d.doc_id
        )
        SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
    """,
    "op5_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                lambda x: x <> '') AS ws
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS g
            FROM w
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d)
        SELECT r.d AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id
        FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
}
