"""DuckDB SQL for the registered queries that SQL can express."""

OP9_LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (
        SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
), common AS (
    SELECT key, max(doc_id) AS keeper
    FROM lines WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(keeper) FILTER (doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key)
GROUP BY doc_id
"""

OP8_VECTOR_DEDUP = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
           embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid
    FROM embeddings
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.valid AND b.valid AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
    SELECT vec_id, vec_id AS other FROM vectors
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM least
"""

OP10_JACCARD = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3),
                                             lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
    SELECT a, b
    FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""

OP11_HARD_NEGATIVES = """
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id AS vec_id, b.row AS row,
           a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.row <> b.row AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor, anchor_id, row, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.row
                               ORDER BY n.score DESC, n.vec_id NULLS LAST, n.row) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n
  ON n.anchor = p.anchor AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op8_vector_dedup": OP8_VECTOR_DEDUP,
    "op10_jaccard": OP10_JACCARD,
    "op9_line_dedup": OP9_LINE_DEDUP,
    "op11_hard_negatives": OP11_HARD_NEGATIVES,
}
