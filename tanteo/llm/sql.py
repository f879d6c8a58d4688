"""DuckDB SQL for the queries that SQL can express, over whole tables."""

QUALITY_RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
grams AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
          FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
             len(string_split(t, chr(10))) AS n_lines,
             regexp_replace(t, '[\x20\x09-\x0D0-9#*$%&|<>!?.,;:''"()\[\]{}_=+/\\@^~`-]', '', 'g') AS letters
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r)),
n AS (SELECT *, length(letters) AS n_letters,
             length(letters) - length(regexp_replace(letters, '\p{Lu}', '', 'g')) AS n_upper,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 20 * word_chars OR 100 * n_dup_lines > 50 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letters < 50 * word_chars OR 100 * n_upper > 60 * n_letters) AS kept
FROM n
"""

NGRAM_JOIN = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS t, min(doc_id) AS id, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT DISTINCT id, array_to_string(words[i : i + 4], ' ') AS gram
      FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.id <> b.id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE 10 * p.n >= 8 * (x.n + y.n - p.n)),
reach AS (SELECT id AS node, id AS root FROM t UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
c AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0) AS n_links, t.n_copies
FROM documents d JOIN t ON t.t = coalesce(d.text, '') JOIN c ON c.node = t.id LEFT JOIN k ON k.a = t.id
"""

PHRASES = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, parts, array_to_string(parts, ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, words[i : i + k - 1] AS parts
        FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(k)))
  GROUP BY lang, parts HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len(parts) > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
         FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM c) c
         JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.parts[1 : k], ' ')
         JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.parts[k + 1 :], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(parts[i : i + k - 1], ' ') AS phrase, max(a) AS around
                FROM (SELECT lang, parts, a, k, unnest(range(1, len(parts) - k + 2)) AS i FROM c, (VALUES (2), (3)) AS t(k) WHERE k < len(parts))
                GROUP BY 1, 2),
free AS (SELECT lowest.* FROM lowest LEFT JOIN inner_parts USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN total USING (lang) QUALIFY rank <= 2000
"""

SPELLING = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce([4294967295] || flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                    ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
           FROM counted, crc),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, i, substring(word, 1, i::INT) || substring(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
longer AS (SELECT DISTINCT cut.word AS a, w.word AS b FROM cut JOIN w ON w.word = cut.rest),
pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
          UNION ALL SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer),
near AS (SELECT a, count(*) AS n_near FROM pairs GROUP BY a),
forms AS MATERIALIZED (SELECT a, b AS form, y.n AS form_n FROM pairs JOIN w x ON x.word = a JOIN w y ON y.word = b WHERE y.n >= 10 * x.n
          QUALIFY row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) = 1),
chain AS (SELECT word, word AS root FROM w UNION ALL SELECT chain.word, form FROM chain JOIN forms ON forms.a = chain.root),
roots AS (SELECT word, root FROM chain ANTI JOIN forms ON forms.a = chain.root)
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, root
FROM w JOIN roots USING (word) LEFT JOIN near ON near.a = w.word LEFT JOIN forms ON forms.a = w.word
"""
