"""DuckDB counterparts of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op3_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(CAST('0x' || md5(concat_ws('|', CAST(doc_id AS VARCHAR), md5(text), 'mix-1'))[1:13] AS BIGINT) AS DOUBLE)
      / 4503599627370496.0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s
), l AS (
  SELECT *, (total - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), f AS (SELECT min_by(level, cap / weight + place * 1e-9) AS level FROM l WHERE cap > level * weight
), t AS (
  SELECT source, source_size, CASE WHEN l.cap > l.level * weight THEN f.level * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM l LEFT JOIN f ON true
), r AS (
  SELECT doc_id, size, source_size, target, u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""

ORACLE["op8_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

ORACLE["op2_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), n AS (SELECT doc_id, i, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM raw),
f AS (SELECT doc_id, i, norm, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM n WHERE norm <> ''),
c0 AS (SELECT *, len(regexp_extract_all(norm, '[^\x20\x09-\x0D]+')) AS n FROM f),
l AS (SELECT doc_id, p, n, norm, lead(norm, 1) OVER d AS norm1, lead(norm, 2) OVER d AS norm2, lead(n, 1) OVER d AS n1 FROM c0 WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
w AS (
  SELECT doc_id, p, 1 AS size, norm AS gram FROM l WHERE n >= 50
  UNION ALL SELECT doc_id, p, 2, norm || chr(10) || norm1 FROM l WHERE n + n1 >= 50
  UNION ALL SELECT doc_id, p, 3, norm || chr(10) || norm1 || chr(10) || norm2 FROM l
), r AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) AS k FROM w WHERE gram IS NOT NULL),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 AND o < size),
x AS (SELECT f.doc_id, f.i FROM f JOIN g USING (doc_id, p)),
c AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (x.i IS NULL) AS clean, count(*) FILTER (n.norm <> '') AS n_lines,
    count(x.i) AS n_deleted, string_agg(CAST(x.i AS VARCHAR), ',' ORDER BY x.i) AS deleted_lines
  FROM n LEFT JOIN x ON n.doc_id = x.doc_id AND n.i = x.i GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_deleted AS BIGINT) AS n_deleted, coalesce(deleted_lines, '') AS deleted_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(clean, '')) END AS clean_sha256
FROM documents d JOIN c USING (doc_id)
"""

ORACLE["op4_substring_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?,;:])([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS parts
  FROM documents WHERE text IS NOT NULL
), raw AS (SELECT doc_id, unnest(parts) AS unit, unnest(range(len(parts))) AS i FROM cut),
n AS (
  SELECT doc_id, i, unit, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM raw
), k AS (
  SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) > 1 AS again,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id, i) AS keeper, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
  FROM n WHERE len(string_split(norm, ' ')) >= 2
), g AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM k WHERE again),
r AS (
  SELECT doc_id, min(i) AS first, max(i) AS last, CAST(min(a) AS BIGINT) AS start, CAST(max(a + length(unit)) AS BIGINT) AS stop, list(DISTINCT keeper) AS keepers
  FROM g GROUP BY doc_id, island HAVING sum(words) >= 25
), p AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed, list_sort(list_distinct(flatten(list(keepers)))) AS kept FROM r GROUP BY doc_id
), c AS (
  SELECT n.doc_id, coalesce(string_agg(unit, '' ORDER BY i) FILTER (r.doc_id IS NULL), '') AS clean
  FROM n LEFT JOIN r ON n.doc_id = r.doc_id AND i BETWEEN r.first AND r.last GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(array_to_string(kept, ','), '') AS kept_in, sha256(clean) AS clean_sha256
FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: crc32 of the UTF-8 bytes of `{0}` beside the table `t`, which is made bit by bit: one step a byte.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
)"""
CRC = """xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(strlen({0}) AS BIGINT)), lambda i: CAST('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])))"""

ORACLE["op11_resample"] = r"""
WITH """ + CRC_TABLE + r""", x AS (
  SELECT doc_id, false AS goal, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, true, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), v AS (SELECT word, """ + CRC.format("word") + r""" % 10000 AS bucket FROM (SELECT DISTINCT word FROM x), crc_table),
f AS (SELECT doc_id, goal, bucket FROM x JOIN v USING (word)),
c AS (SELECT bucket, count(*) FILTER (NOT goal) AS s, count(*) FILTER (goal) AS t FROM f GROUP BY bucket),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS big_s, CAST(sum(t) AS DOUBLE) AS big_t FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (big_s + 10000) / ((s + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS gain FROM c, a),
w AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE NOT goal GROUP BY doc_id),
z AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || sha256('2024:' || CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS h FROM documents LEFT JOIN w USING (doc_id)
), o AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS rows FROM o WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * rows // 100 THEN rank END AS rank FROM o LEFT JOIN r USING (doc_id)
"""

ORACLE["op12_spelling"] = r"""
WITH RECURSIVE """ + CRC_TABLE + r""", x AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), d AS (SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS named FROM x WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, """ + CRC.format("named") + r""" AS h FROM d, crc_table),
s AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, unnest(range(CAST(length(word) AS BIGINT))) AS i FROM w),
v AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS part FROM g),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.part = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.part = w.word
), b AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word AND b.k = 1
), r AS (
  SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.next = f.word
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word AND r.next IS NULL
"""
