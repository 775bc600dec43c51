"""Reference SQL (DuckDB) for the operators that SQL can express."""

LINE_FREQUENCY = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), word AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM doc
), win AS (
  SELECT r, unnest(generate_series(1, len(w) - 7)) AS p, w FROM word WHERE len(w) >= 8
), twice AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, list_aggregate(w[p:p + 7], 'string_agg', ' ')) AS c FROM win
), rep AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + 7)) AS q FROM twice WHERE c > 1) GROUP BY r
), line AS (
  SELECT r, host, md5(text) AS k, unnest(string_split(text, chr(10))) AS l FROM doc
), worded AS (
  SELECT r, host, k, l, len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n,
    regexp_replace(trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), often AS (
  SELECT host, norm FROM worded GROUP BY host, norm HAVING count(DISTINCT k) > 10
), gone AS (
  SELECT r, sum(n) AS n FROM worded SEMI JOIN often USING (host, norm) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words,
    length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(w) - coalesce(gone.n, 0) AS left_words
  FROM doc JOIN word USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r) LEFT JOIN dup USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_words >= 20 AND 100 * left_words >= 30 * n_words AS kept,
  CAST(left_words AS BIGINT) AS left_words
FROM m
"""

DECONTAMINATION = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), need AS (
  SELECT DISTINCT item, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p
        FROM item WHERE len(w) > 0)
), win AS (
  SELECT r, p, n, list_aggregate(w[p:p + n - 1], 'string_agg', ' ') AS win
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
        FROM doc, (SELECT DISTINCT n FROM need) WHERE len(w) >= n)
), found AS (
  SELECT r, p, n, item FROM win JOIN need USING (n, win)
), hit AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM found) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS listed FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

MERKLE = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END ||
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS front,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS back
  FROM documents
), bits AS (
  -- CRC-32 of the decimal id, a byte at a time: eight shifts for each
  SELECT r, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM doc WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, s, i + 1,
    list_reduce([xor(c, CAST(ascii(s[i + 1]) AS BIGINT)), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM bits WHERE i < length(s)
), crc AS (
  SELECT r, xor(c, 4294967295) AS crc FROM bits WHERE i = length(s)
), leaf AS (
  SELECT doc.r, doc_id, lang,
    sha256(front || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || back) AS leaf,
    CASE WHEN coalesce(crc % 7 = 0, false)
      THEN sha256(front || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END || back)
    END AS changed
  FROM doc LEFT JOIN crc USING (r)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY CAST(lang AS BLOB) NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM leaf
), lower_node AS (
  SELECT g, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM lower_node WHERE n > 1 GROUP BY g, level, pos // 2, n
), subroot AS (
  SELECT g, max(level) AS height, max_by(digest, level) AS digest FROM lower_node WHERE n = 1 GROUP BY g
), upper_node AS (
  SELECT 0 AS level, g AS pos, digest, (SELECT count(*) FROM subroot) AS n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM upper_node WHERE n > 1 GROUP BY level, pos // 2, n
), step AS (
  SELECT p.r, k AS level, p.pos >> k AS idx, s.digest AS sibling
  FROM (SELECT placed.*, unnest(generate_series(0, height - 1)) AS k FROM placed JOIN subroot USING (g) WHERE height > 0) p
  LEFT JOIN lower_node s ON s.g = p.g AND s.level = k AND s.pos = xor(p.pos >> k, 1)
  UNION ALL
  SELECT p.r, height + k, p.g >> k, s.digest
  FROM (SELECT placed.*, height, unnest(generate_series(0, (SELECT max(level) FROM upper_node) - 1)) AS k
        FROM placed JOIN subroot USING (g) WHERE (SELECT max(level) FROM upper_node) > 0) p
  LEFT JOIN upper_node s ON s.level = k AND s.pos = xor(p.g >> k, 1)
), proof AS (
  SELECT r, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof_sha256, count(*) AS steps FROM step GROUP BY r
), fold AS (
  SELECT r, 0 AS level, coalesce(changed, leaf) AS digest FROM placed
  UNION ALL
  SELECT r, fold.level + 1,
    sha256(CASE WHEN sibling IS NULL THEN digest WHEN idx % 2 = 1 THEN sibling || digest ELSE digest || sibling END)
  FROM fold JOIN step USING (r) WHERE step.level = fold.level
), top AS (
  SELECT r, max_by(digest, level) AS folded_root FROM fold GROUP BY r
)
SELECT doc_id, leaf, subroot.digest AS subroot, (SELECT digest FROM upper_node WHERE n = 1) AS root,
  coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = (SELECT digest FROM upper_node WHERE n = 1) AS verified
FROM placed JOIN subroot USING (g) LEFT JOIN proof USING (r) JOIN top USING (r)
"""

ORACLES = {
    "op4_line_frequency": LINE_FREQUENCY,
    "op9_decontamination": DECONTAMINATION,
    "op12_time_forward_merkle": MERKLE,
}
