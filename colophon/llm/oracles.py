"""The queries that SQL can express, in DuckDB's SQL. They take doc_id as unique, as it is in the test tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NORM = r"lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')))"

OP3 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
starts AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again
  FROM (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS g FROM w, unnest(range(1, len(words) - 18)) AS u(i))),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM starts, range(20) AS r(k) WHERE again),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM (SELECT doc_id, i, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS u(i)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS u(i) WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) m USING (doc_id)"""

OP10 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, range(3) AS r(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, source, text, {NORM} AS h FROM (SELECT doc_id, source, text, unnest(lines) AS line FROM w)),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM l GROUP BY source),
often AS (SELECT l.source, h FROM l JOIN hosts ON l.source IS NOT DISTINCT FROM hosts.source GROUP BY l.source, h HAVING count(DISTINCT text) >= 5 AND count(DISTINCT text) > 0.05 * max(docs)),
removed AS (SELECT doc_id, sum(len(string_split(l.h, ' '))) AS n FROM l JOIN often ON l.source IS NOT DISTINCT FROM often.source AND l.h = often.h GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words > gone AND n_words - gone >= 0.2 * n_words) AS kept FROM base"""

OP11 = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS t(i)),
hidden AS (SELECT *, CASE WHEN regexp_matches(text, '\\[/?INST\\]|<</?SYS>>|</s>|<<ROLE |<</ROLE>>') OR regexp_matches(text, '\\\\[\\\\\\[<>]|\\\\$')
  THEN regexp_replace(regexp_replace(text, '\\\\', '\\\\\\\\', 'g'), '(\\[/?INST\\]|<</?SYS>>|</s>|<<ROLE |<</ROLE>>)', '\\\\\\1', 'g') ELSE text END AS shown FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM hidden GROUP BY conv_id"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents), n AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS words FROM n), q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, total GROUP BY term, docs),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN n USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

ORACLES = {"op3_substring_dedup": OP3, "op4_jaccard_join": OP4, "op10_quality_rules": OP10, "op11_chat_format": OP11, "op13_ranked_search": OP13}
