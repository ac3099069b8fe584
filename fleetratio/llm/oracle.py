"""Plain SQL for the registered queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, ((rank - 1) % 3)::INT AS kind, [3, 1, 2][(rank - 1) % 3 + 1]::BIGINT AS w, 2 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS everything FROM totals
), filled AS (
  SELECT *, sum(cap) OVER o - cap AS given, sum(w) OVER () - sum(w) OVER o + w AS still
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING)
), judged AS (
  SELECT *, (3 * everything - 2 * given) * w > 2 * still * cap AS is_full FROM filled
), level AS (
  SELECT 3 * max(everything) - 2 * coalesce(sum(CASE WHEN is_full THEN cap END), 0) AS remainder, coalesce(sum(CASE WHEN NOT is_full THEN w END), 1) AS still FROM judged
), targets AS (
  SELECT j.source, kind, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (l.remainder * w)::DOUBLE / (2 * l.still)::DOUBLE END AS target FROM judged j, level l
), queued AS (
  SELECT s.doc_id, s.size, t.kind, t.source_size, t.target, floor(t.target)::BIGINT AS wanted,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, greatest(0, least(size, wanted - start)) AS t0, greatest(0, least(size, wanted - start - source_size)) AS t1 FROM queued
), visited AS (
  SELECT *, CASE WHEN t0 > 0 THEN (start::DOUBLE + t0::DOUBLE / 2.0) / wanted::DOUBLE END AS share FROM taken
)
SELECT doc_id, size, source_size, target, (t0 + t1)::BIGINT AS taken,
  round(CASE kind
    WHEN 0 THEN 2.0::DOUBLE * share / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * share))
    WHEN 1 THEN share
    ELSE CASE WHEN share <= 0.3125::DOUBLE THEN 2.0::DOUBLE * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 1.0::DOUBLE * share))
      ELSE 0.5::DOUBLE + 2.0::DOUBLE * (share - 0.3125::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 5.0::DOUBLE * (share - 0.3125::DOUBLE))) END
  END, 9) AS first_position
FROM visited
"""

OP6 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, row_number() OVER () AS row FROM documents
), windows AS (
  SELECT row, i, words[i:i + 4] AS win FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT p)::BIGINT AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY row
), stats AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (row)
), counted AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 4 * n_symbols > n_words OR 2 * n_dup_lines > len(ls)) AS kept
FROM counted
"""

#: The table of the reflected CRC-32 by its rule, then the CRC of each distinct word byte by byte.
OP11 = r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)
), worded AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), benchmarked AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), uses AS (
  SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM worded) GROUP BY row, word
), vocabulary AS (
  SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM uses UNION SELECT word FROM benchmarked)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM vocabulary, crc_table
), s AS (
  SELECT bucket, sum(n)::DOUBLE AS s FROM uses JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*)::DOUBLE AS t FROM benchmarked JOIN hashed USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM s) AS big_s, (SELECT coalesce(sum(t), 0) FROM t) AS big_t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals
), weights AS (
  SELECT row, sum(n * gain)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT doc_id, row, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row)
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place::BIGINT END AS rank FROM scored LEFT JOIN placed USING (row)
"""

OP13 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, row, CASE WHEN len(words) < 2 THEN words ELSE list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) END AS shingles FROM worded
), classes AS (
  SELECT shingles, min(row) AS class, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), uses AS (
  SELECT class, n, unnest(shingles) AS shingle FROM classes
), pairs AS (
  SELECT a.class AS a, b.class AS b FROM uses a JOIN uses b ON a.shingle = b.shingle AND a.class < b.class AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reached(node, root) AS (
  SELECT class, class FROM classes UNION SELECT l.b, r.root FROM reached r JOIN links l ON r.node = l.a
), roots AS (
  SELECT node AS class, min(root) AS root FROM reached GROUP BY node
), grouped AS (
  SELECT s.doc_id, s.row, coalesce(r.root, -s.row) AS root, len(s.shingles) AS n_shingles FROM sets s LEFT JOIN classes c USING (shingles) LEFT JOIN roots r ON r.class = c.class
), labelled AS (
  SELECT doc_id, n_shingles::BIGINT AS n_shingles, min(doc_id) OVER (PARTITION BY root) AS component_id FROM grouped
)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM labelled
"""

LLM_ORACLE = {"op4_curriculum_mix": OP4, "op6_rule_cascade": OP6, "op11_overlapped_resampling": OP11, "op13_oneperm_minhash": OP13}
