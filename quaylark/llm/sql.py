"""SQL for DuckDB of the operators on phrases and conversations."""

from __future__ import annotations

from . import collocations, prefixtrie


def collocations_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    k, least, first, cover = collocations.LONGEST, collocations.LEAST, collocations.FIRST, collocations.COVER
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, generate_series(1, {k}) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, gram, string_split(gram, ' ') AS w, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, gram HAVING count(*) >= {least}),
inside AS (SELECT lang, gram, max(f) AS f FROM (
    SELECT lang, f, array_to_string(w[i:i + size - 1], ' ') AS gram
    FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM f WHERE k > 2)))
  GROUP BY lang, gram),
c AS (SELECT f.lang, f.gram, f.w, f.k, f.f AS a FROM f LEFT JOIN inside USING (lang, gram) WHERE f.k > 1 AND (inside.f IS NULL OR 100 * inside.f < {cover} * f.f)),
cuts AS (SELECT lang, gram, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
s AS (SELECT cuts.lang, cuts.gram, a, cut, x.f AS l, y.f AS r, n.n, (1000 * a * n.n) // (x.f * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.gram = head JOIN f y ON y.lang = cuts.lang AND y.gram = tail JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, gram AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {first}"""


def prefix_trie_sql() -> str:
    """Paths are the MD5 digests of their turns, end to end, so that a prefix of a path is a path."""
    # crc32, bit by bit: 3988292384 is its reversed polynomial
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    crc = "c::VARCHAR"
    digits = f"list_transform(string_split({crc}, ''), lambda x: ascii(x)::BIGINT)"
    byte = f"list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda a, i: {step}, xor(v, d))"
    crc32 = f"xor(list_reduce({digits}, lambda v, d: {byte}, 4294967295::BIGINT), 4294967295)"
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT t.c, p, md5(role || chr(31) || length(role) || chr(31) || txt) AS turn, length(txt) AS chars FROM t),
k AS (SELECT c, c - c % {prefixtrie.FAMILY} AS b, {crc32} % {prefixtrie.SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, 0 AS own, p, turn, chars FROM k JOIN m ON m.c = k.b WHERE p <= h
  UNION ALL SELECT k.c, 1, p, turn, chars FROM k JOIN m ON m.c = k.c WHERE p > h),
steps AS (
  SELECT c, row_number() OVER w AS d, string_agg(turn, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY c ORDER BY own, p)
  UNION ALL SELECT c, 0, '', 0 FROM k),
nodes AS (SELECT path, d, min(c) AS c, count(*) AS n, min(chars) AS chars FROM steps GROUP BY path, d),
ends AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(path, d) AS path FROM steps GROUP BY c) GROUP BY path),
kids AS (SELECT left(path, 32 * (d - 1)::BIGINT) AS path, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (path)),
sums AS (
  SELECT v.path, count(*) FILTER (u.kids = 0) AS leaves, sum((u.n - 1) * u.chars) AS saved
  FROM full_nodes v JOIN full_nodes u ON u.d >= v.d AND left(u.path, 32 * v.d::BIGINT) = v.path GROUP BY v.path)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, parent.c AS parent_conv_id, v.n::BIGINT AS n_convs, v.kids::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM full_nodes v JOIN sums USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes parent ON v.d > 0 AND parent.path = left(v.path, 32 * (v.d - 1)::BIGINT)"""
