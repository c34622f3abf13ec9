"""DuckDB SQL of the operators whose whole result plain SQL can express: direct, quadratic
where it must be, and independent of the methods."""

_WORDS = "regexp_extract_all(coalesce({0}, ''), '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
m AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m, d.doc_id), d.doc_id) AS component_id,
  d.doc_id = least(coalesce(m, d.doc_id), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS num FROM documents),
k AS (SELECT doc_id, num, array_to_string({_WORDS.format(_LOWER.format('x'))}, ' ') AS line, len({_WORDS.format('x')}) AS n FROM l),
b AS (SELECT *, row_number() OVER o AS p, sum(n) OVER o AS cum FROM k WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY num)),
v AS (SELECT a.doc_id, a.p, max(z.p) AS e, string_agg(z.line, chr(10) ORDER BY z.p) AS content FROM b a JOIN b z
  ON z.doc_id = a.doc_id AND z.p >= a.p AND z.cum - z.n - (a.cum - a.n) < 50 GROUP BY a.doc_id, a.p HAVING sum(z.n) >= 50),
r AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, p) > 1),
g AS (SELECT DISTINCT b.doc_id, b.num FROM b JOIN r ON r.doc_id = b.doc_id AND b.p BETWEEN r.p AND r.e)
SELECT d.doc_id, (SELECT count(*) FROM b WHERE b.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n_removed,
  coalesce((SELECT string_agg(CAST(num AS VARCHAR), ',' ORDER BY num) FROM g WHERE g.doc_id = d.doc_id), '') AS removed FROM documents d"""


def quality_rules(few_docs: int, max_host_mille: int, min_words: int, min_kept: float) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
g AS (SELECT doc_id, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
h AS (SELECT doc_id, p FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM h, range(5) t(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS num FROM d),
dl AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM l WHERE len({_WORDS.format('x')}) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, x ORDER BY num) > 1) GROUP BY doc_id),
nl AS (SELECT doc_id, source, array_to_string({_WORDS.format("translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')")}, ' ') AS line, len({_WORDS.format('x')}) AS n FROM l),
ho AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
f AS (SELECT nl.source, line FROM nl JOIN ho ON ho.source IS NOT DISTINCT FROM nl.source WHERE n > 0 GROUP BY nl.source, line, docs
  HAVING count(DISTINCT doc_id) > {few_docs} AND count(DISTINCT doc_id) * 1000 > docs * {max_host_mille}),
rm AS (SELECT doc_id, sum(n) AS n FROM nl JOIN f ON f.line = nl.line AND f.source IS NOT DISTINCT FROM nl.source GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, CAST(coalesce(rm.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dl ON dl.doc_id = d.doc_id LEFT JOIN rw ON rw.doc_id = d.doc_id LEFT JOIN rm ON rm.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - removed_words >= {min_words} AND n_words - removed_words >= {min_kept} * n_words AS kept FROM m"""
