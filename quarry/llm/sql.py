"""DuckDB SQL for the queries that SQL can express over whole tables."""

from quarry.llm.quality import STOP_WORDS

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'),
                                  (-1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'))
), escaped AS (
  SELECT *, regexp_replace(replace(role, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '\0+', 'g') AS role_x,
            regexp_replace(replace(text, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]', '\0+', 'g') AS text_x
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  CAST(sum(length('<s>[INST] ') + length(role_x) + length(' [/INST]') + length(text_x) + length('</s>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP10 = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r (verdict, rule_host, rule_path)
), found AS (
  SELECT page_id, host, path, (SELECT max_by(rule_host || rule_path || ' ' || verdict, length(rule_host) * 1000 + length(rule_path)) FROM rules
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS hit
  FROM parts
)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, coalesce(nullif(split_part(coalesce(hit, ''), ' ', 2), ''), 'allow') AS verdict FROM found
"""

_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))
OP3 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM parts)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeated AS (
  SELECT r, sum(least(8, coalesce(after - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM twice) GROUP BY r
), measures AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(t) AS BIGINT) AS n_chars, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) - coalesce(list_sum(list_transform(list_distinct(lines), lambda x: length(x))), 0) AS BIGINT) AS dup_line_chars,
    CAST(len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(lines, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•'))) AS BIGINT) AS n_bullet_lines,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_alpha_words,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM parts p LEFT JOIN repeated USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND word_chars >= 2.0 * n_words AND word_chars <= 12.0 * n_words AND n_symbols <= 0.2 * n_words AND n_dup_lines <= 0.5 * n_lines
  AND dup_line_chars <= 0.5 * n_chars AND n_ellipsis_lines <= 0.3 * n_lines AND n_bullet_lines <= 0.9 * n_lines
  AND n_alpha_words >= 0.6 * n_words AND n_upper <= 0.4 * n_chars AND (n_stop_words >= 0.02 * n_words OR n_words < 50) AS kept
FROM measures
"""

OP6 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), item_runs AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), doc_runs AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS run
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM item_runs) WHERE len(w) >= size)
), met AS (
  SELECT r, i, size, item_id FROM doc_runs JOIN item_runs USING (size, run)
), per_doc AS (
  SELECT r, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items, count(DISTINCT item_id) AS n_items FROM met GROUP BY r
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN per_doc USING (r) LEFT JOIN hit_words USING (r)
"""

OP12 = r"""
WITH parts AS (
  SELECT row_number() OVER () AS r, stamp_id, source, zone, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM stamps
), matched AS (
  SELECT *, regexp_extract(t, '^(?:(20[0-9]{2})-([0-9]{2})-([0-9]{2})|(20[0-9]{2})([0-9]{2})([0-9]{2})|([0-9]{2})\.([0-9]{2})\.(20[0-9]{2})|([0-9]{2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9]{2})|([0-9]{2})/([0-9]{2})/(20[0-9]{2}))(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z',
    ['y1', 'm1', 'd1', 'y2', 'm2', 'd2', 'd3', 'm3', 'y3', 'd4', 'b4', 'y4', 'a5', 'b5', 'y5', 'h', 'mi', 's', 'half', 'off']) AS x FROM parts
), dates AS (
  SELECT *, x.y1 || x.y2 || x.y3 || x.y4 || x.y5 AS y, x.y5 <> '' AS slashed,
    CASE WHEN x.b4 <> '' THEN lpad(CAST((position(x.b4 IN 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 AS VARCHAR), 2, '0') ELSE x.m1 || x.m2 || x.m3 || x.a5 END AS m, x.d1 || x.d2 || x.d3 || x.d4 || x.b5 AS d FROM matched
), tried AS (
  SELECT *, CASE WHEN y <> '' THEN TRY_CAST(y || '-' || m || '-' || d AS DATE) END AS one, CASE WHEN slashed THEN TRY_CAST(y || '-' || d || '-' || m AS DATE) WHEN y <> '' THEN TRY_CAST(y || '-' || m || '-' || d AS DATE) END AS two,
    coalesce(TRY_CAST(x.h AS INT), 0) AS hour, coalesce(TRY_CAST(x.mi AS INT), 0) AS minute, coalesce(TRY_CAST(x.s AS INT), 0) AS sec,
    CASE WHEN x.off = '' THEN NULL WHEN x.off = 'Z' THEN 0 ELSE (TRY_CAST(x.off[2:3] AS INT) * 60 + TRY_CAST(x.off[-2:] AS INT)) * CASE WHEN x.off[1:1] = '-' THEN -1 ELSE 1 END END AS off_min,
    coalesce(TRY_CAST(x.off[2:3] AS INT) <= 14 AND TRY_CAST(x.off[-2:] AS INT) < 60, x.off IN ('', 'Z')) AS off_ok FROM dates
), valid AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{10}') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '[0-9]{13}') THEN TRY_CAST(t AS BIGINT) * 1000 END AS epoch,
    CASE WHEN x.half = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE WHEN x.half = 'P' THEN 12 ELSE 0 END END AS hours FROM tried
), good AS (
  SELECT *, coalesce(epoch IS NULL AND (one IS NOT NULL OR two IS NOT NULL) AND hours < 24 AND minute < 60 AND sec < 60 AND off_ok, false) AS dated FROM valid
), votes AS (
  SELECT source, count(*) FILTER (two IS NULL) AS a, count(*) FILTER (one IS NULL) AS b FROM good WHERE dated AND slashed GROUP BY source
), chosen AS (
  SELECT g.*, CASE WHEN NOT dated THEN NULL WHEN one <> two THEN CASE WHEN coalesce(a, 0) > 3 * coalesce(b, 0) OR coalesce(b, 0) > 3 * coalesce(a, 0) THEN 'votes' ELSE 'default' END ELSE 'plain' END AS how,
    CASE WHEN one <> two AND coalesce(b, 0) > 3 * coalesce(a, 0) THEN two ELSE coalesce(one, two) END AS day FROM good g LEFT JOIN votes v ON g.source IS NOT DISTINCT FROM v.source
), walls AS (
  SELECT *, CASE WHEN dated THEN CAST(day AS TIMESTAMP) + to_seconds(hours * 3600 + minute * 60 + sec) END AS wall FROM chosen
), placed AS (
  SELECT *, CASE WHEN off_min IS NULL THEN wall AT TIME ZONE zone END AS u FROM walls
), earlier AS (
  SELECT *, CASE WHEN (u - INTERVAL 1 HOUR) AT TIME ZONE zone = wall THEN u - INTERVAL 1 HOUR ELSE u END AS u0,
    u IS NOT NULL AND ((u AT TIME ZONE zone) <> wall OR (u - INTERVAL 1 HOUR) AT TIME ZONE zone = wall OR (u + INTERVAL 1 HOUR) AT TIME ZONE zone = wall) AS odd FROM placed
)
SELECT stamp_id, CASE WHEN epoch IS NOT NULL THEN epoch WHEN NOT dated THEN NULL WHEN off_min IS NULL THEN epoch_us(u0) ELSE epoch_us(wall) - off_min * CAST(60000000 AS BIGINT) END AS utc_us,
  CASE WHEN epoch IS NOT NULL THEN 'epoch' ELSE coalesce(how, 'bad') END AS rule, coalesce(how IN ('votes', 'default') OR odd, false) AS ambiguous
FROM earlier
"""

OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), tokens AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) USING (lang)
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, v, l.n AS lang_n, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM docs) JOIN langs l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source) c USING (lang, source)
), probabilities AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.n + 5 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (lang_n + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS d FROM probabilities x JOIN probabilities y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM probabilities WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op3_quality_rules": OP3, "op6_decontamination": OP6, "op8_chat_format": OP8, "op10_url_filter": OP10, "op12_stamps": OP12, "op13_divergence": OP13}
