"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JACCARD = rf"""WITH RECURSIVE
  w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
  g AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
  both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
  reach AS (SELECT DISTINCT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.c)
  SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

CHAT_FORMAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  e AS (SELECT *, role || chr(10) || text || chr(10) AS whole, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, regexp_replace(role || text, '[^\\<#]', '', 'g') AS special FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(whole, '' ORDER BY turn, role, text)) AS turns_sha256, sum(length(loss))::BIGINT AS loss_chars,
    sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(20 + length(role) + length(text) + length(special))::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

MIXING = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size,
    ((('0x' || substr(md5(doc_id || ':mix'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM d GROUP BY source),
  w AS (SELECT *, [5::DOUBLE, 2::DOUBLE, 1::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, source_size * 2::DOUBLE AS cap FROM s),
  r AS (SELECT *, row_number() OVER o AS pos, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
  f AS (SELECT *, (SELECT arg_min(level, pos) FROM r WHERE level * w <= cap) AS found FROM r),
  t AS (SELECT source, source_size, docs, least(cap, coalesce(found * w, cap)) AS target FROM f),
  p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
  q AS (SELECT *, target - whole * source_size AS need, least(1::DOUBLE - 1::DOUBLE / 1048576, (target - whole * source_size) / source_size) AS part, source_size / docs AS mean FROM p),
  k AS (SELECT d.*, q.* EXCLUDE (source), (u / (1::DOUBLE - u)) / ((part / (1::DOUBLE - part)) * greatest(0.5::DOUBLE, least(2::DOUBLE, sqrt(size / mean)))) AS score FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
  c AS (SELECT *, need > 0 AND sum(size) OVER (PARTITION BY source ORDER BY score, doc_id::VARCHAR RANGE UNBOUNDED PRECEDING) <= need AS inside FROM k),
  m AS (SELECT source, need - coalesce(sum(size) FILTER (inside), 0) AS missing FROM c GROUP BY source, need),
  z AS (SELECT c.source AS source, arg_min(doc_id, (abs(size - missing), score, doc_id::VARCHAR)) AS closing FROM c JOIN m ON c.source IS NOT DISTINCT FROM m.source WHERE need > 0 AND NOT inside AND abs(size - missing) < missing GROUP BY c.source)
  SELECT doc_id, size, source_size, target, size * (whole + (CASE WHEN inside OR doc_id IS NOT DISTINCT FROM closing THEN 1 ELSE 0 END)) AS taken FROM c LEFT JOIN z ON c.source IS NOT DISTINCT FROM z.source"""

#: CRC-32 by its table, which eight steps a byte make. `{crc}` of a UTF-8 string's bytes is what zlib's crc32 says.
CRC_TABLE = "SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS crcs"
CRC = "xor(list_reduce(list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(crcs[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"

IMPORTANCE = rf"""WITH lut AS ({CRC_TABLE}),
  d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
  f AS (SELECT doc_id, unnest(ws) AS w FROM d),
  g AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
  v AS (SELECT w, {CRC.format(s="w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), lut),
  s AS (SELECT bucket, count(*) AS s FROM f JOIN v USING (w) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS t FROM g JOIN v USING (w) GROUP BY bucket),
  z AS (SELECT (SELECT count(*) FROM f) AS s_all, (SELECT count(*) FROM g) AS t_all),
  gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), z),
  w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN v USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
  x AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
  y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos, 10 * count(*) OVER () // 100 AS wanted FROM x WHERE n_features >= 20)
  SELECT x.doc_id AS doc_id, n_features, weight, score, CASE WHEN pos <= wanted THEN pos END AS rank FROM x LEFT JOIN y ON y.doc_id = x.doc_id"""

#: Near words share what is left of them without the letter at one place (replaced), or one of them is what is left of the other (inserted).
SPELLING = rf"""WITH RECURSIVE lut AS ({CRC_TABLE}),
  r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
  k AS (SELECT id, run, count(*) AS n FROM r GROUP BY id, run),
  h AS (SELECT run, n, {CRC.format(s="id || ':' || run")} AS h FROM k, lut),
  w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
  v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
  g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
  e AS (SELECT a.word AS word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
  m AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM e GROUP BY word),
  f AS (SELECT v.word AS word, v.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN m ON m.word = v.word),
  c AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT f.word AS word, form, z.root AS root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM c GROUP BY word) z ON z.word = f.word"""

LINE_DEDUP = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  h AS (SELECT key, max(doc_id) AS keeps FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
  v AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> keeps AS gone FROM k LEFT JOIN h ON h.key = k.key)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM v GROUP BY doc_id"""

ORACLE_SQL = {"op11_line_dedup": LINE_DEDUP, "op12_spelling": SPELLING, "op13_importance": IMPORTANCE, "op1_ngram_jaccard": NGRAM_JACCARD, "op5_chat_format": CHAT_FORMAT, "op10_mixing": MIXING}
