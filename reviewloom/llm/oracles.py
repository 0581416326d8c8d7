"""DuckDB SQL with the rows of the corpus queries, where SQL can express them."""

OP2 = """
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages
), rules(h, p, v) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), judged AS (
    SELECT *,
           (SELECT max(struct_pack(size := length(h || p), rule := h || p, verdict := v)) FROM rules
            WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best,
           CASE WHEN host = '' THEN NULL
                WHEN regexp_matches(host, '(^|[^0-9A-Za-z])free-bets($|[^0-9A-Za-z])') THEN 'free bets'
                WHEN regexp_matches(host, '(^|[^0-9A-Za-z])cheap-pills($|[^0-9A-Za-z])') THEN 'cheap pills'
                WHEN regexp_matches(host, '(^|[^0-9A-Za-z])casino($|[^0-9A-Za-z])') THEN 'casino' END AS spam
    FROM parts
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN spam IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best IS NULL THEN spam END AS pattern
FROM judged
"""

OP3 = """
WITH payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), winners AS (
    SELECT payload_digest, max(page_id) AS winner FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest
), marked AS (SELECT *, coalesce(page_id <> winner, false) AS again FROM payloads LEFT JOIN winners USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN winner END AS refers_to
FROM marked
"""

OP4 = r"""
WITH texts AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
           length(coalesce(text, '')) AS n_points
    FROM documents
), grouped AS (
    SELECT text_sha256, count(*) AS group_size,
           arg_min(doc_id, struct_pack(a := -n_points, b := doc_id)) AS keep_id
    FROM texts GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM texts JOIN grouped USING (text_sha256)
"""

OP6 = r"""
WITH split AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM split
), shared AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
    GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, line, pos, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = r"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
          FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)
), found AS (SELECT doc_id, size, i, item FROM doc_windows JOIN item_windows USING (size, gram)
), hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found)
    GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAREST12 = """
assigned{r} AS MATERIALIZED (
    SELECT vec_id, any_value(label) AS label, p, any_value(v) AS v,
           min(struct_pack(d := d, e := e)) AS best
    FROM (SELECT vec_id, label, p, e, parts.v,
                 list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM parts JOIN book{r} b USING (p))
    GROUP BY vec_id, p
)"""

_NEXT12 = """
sums{r} AS (
    SELECT p, best.e AS e, i, sum(v[i]) AS s, count(*) AS c FROM assigned{r}, range(1, len(v) + 1) t(i) GROUP BY p, best.e, i
), means{r} AS (
    SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS v FROM sums{r} GROUP BY p, e
), book{n} AS MATERIALIZED (
    SELECT p, e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (p, e)
)"""

OP12 = (
    """
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, range(16) t(p)
), book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM parts
    QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 64
), """
    + ", ".join([_NEAREST12.format(r=0), _NEXT12.format(r=0, n=1), _NEAREST12.format(r=1), _NEXT12.format(r=1, n=2), _NEAREST12.format(r=2)])
    + """, digest AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
), coded AS (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
           CAST(sum(best.d) AS BIGINT) AS error
    FROM assigned2 GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, digest
"""
)

OP13 = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
    SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(0 AS BIGINT) FOR x IN range(8)]),
                              lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c
        FROM range(256) r(b))
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), pairs AS (
    SELECT doc_id, run, count(*) AS k,
           flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
               lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                         ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END)) AS bytes
    FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), hashed AS (
    SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
                                   lambda a, x: xor(t[xor(a % 256, x) + 1], a // 256)), CAST(4294967295 AS BIGINT)) AS h
    FROM pairs, crc_table
), words AS MATERIALIZED (
    SELECT word, CAST(sum(k) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
          FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), cut AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
    SELECT a.word AS word, b.word AS other, b.n AS n
    FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, min(struct_pack(m := -n, w := other)) AS top FROM near GROUP BY word
), forms AS MATERIALIZED (
    SELECT word, words.n AS n, coalesce(n_near, 0) AS n_near,
           CASE WHEN -top.m >= 10 * words.n THEN top.w END AS form, CASE WHEN -top.m >= 10 * words.n THEN -top.m END AS form_n
    FROM words LEFT JOIN best USING (word)
), way(word, place) AS (
    SELECT word, word FROM forms
    UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.place WHERE forms.form IS NOT NULL
), last AS (
    SELECT way.word, way.place AS root FROM way JOIN forms ON forms.word = way.place WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""

OPERATORS = {
    "op2_url_filters": OP2,
    "op3_warc": OP3,
    "op4_exact_dedup": OP4,
    "op6_line_dedup": OP6,
    "op10_decontamination": OP10,
    "op12_vector_codes": OP12,
    "op13_spelling_variants": OP13,
}
