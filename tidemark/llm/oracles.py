"""DuckDB SQL for the operators that SQL can express.

The others depend on tokenizers, on a language model's logarithms, on checksums that DuckDB hasn't, or on regular expressions' places.
"""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

#: Windows of 35 words as text: a word holds no space, so one space between words tells all sequences apart.
_SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (s)),
places AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(coalesce(ps, [])) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN places USING (r)
"""

_JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r <> b.r GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v),
least AS (SELECT u AS r, min(doc_id) AS c FROM reach JOIN d ON d.r = v GROUP BY u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""

#: Scores have at most some 90 bits here, so 128 do.
_COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 100),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS c FROM often WHERE k > 1),
scored AS (SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, n, c, (1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS score FROM cut JOIN total USING (lang)
  JOIN often l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1:c], ' ') JOIN often r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
gone AS (SELECT DISTINCT o.lang, o.phrase FROM often o JOIN often b ON b.lang = o.lang AND b.k > o.k AND b.a >= o.a AND contains(' ' || b.phrase || ' ', ' ' || o.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""

_NEGATIVES = """
WITH e AS (SELECT row_number() OVER () AS x, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pair AS (SELECT a.x AS ax, a.vec_id AS anchor_id, b.x AS bx, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score FROM e a JOIN e b ON a.x <> b.x WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY ax ORDER BY score DESC, other_id, bx) <= 5),
found AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.ax, p.bx ORDER BY n.score DESC, n.other_id, n.bx)::INTEGER AS rank
  FROM positive p JOIN pair n ON n.ax = p.ax AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""

SQL: dict[str, str] = {"op2_substring_dedup": _SUBSTRINGS, "op6_ngram_jaccard_join": _JACCARD, "op11_collocations": _COLLOCATIONS, "op13_hard_negatives": _NEGATIVES}
