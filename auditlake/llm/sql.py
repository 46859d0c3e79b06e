"""DuckDB SQL for the contract queries that SQL can express, by brute force."""

from __future__ import annotations

_COMPONENTS = """
paired AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM paired UNION SELECT r.x, e.b FROM reach r JOIN paired e ON e.a = r.y),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0"

TOP_K = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS e FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings WHERE {_USABLE} AND label IS NOT NULL AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM paired GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.x = vec_id"""

_SPACE = r"[\x09-\x0D ]+"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM u p JOIN u q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b WHERE 100 * c.n >= 80 * (len(p.s) + len(q.s) - c.n)),
{_COMPONENTS}
SELECT doc_id, len(s) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN comp ON comp.x = doc_id"""

SUBSTRINGS = rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h SEMI JOIN twice USING (h)),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM w),
kept AS (SELECT e.doc_id, count(g.j) AS n_removed, coalesce(string_agg(e.x, ' ' ORDER BY e.j) FILTER (WHERE g.j IS NULL), '') AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.j = e.j GROUP BY e.doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

CHATS = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(12 + length(role) + 1 + length(text) + 10 + 1 + len(regexp_extract_all(text, '<\|\\*im_(start|end)\|>'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

PHRASES = r"""WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
o AS (SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE i + len - 1 <= len(w)),
f AS (SELECT lang, len, phrase, count(*) AS a FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE len > 1 AND a >= 30),
k AS (SELECT *, unnest(range(1, len)) AS k FROM c),
s AS (SELECT k.*, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (x.a + y.a) AS BIGINT) AS score FROM k
 JOIN f x ON x.lang = k.lang AND x.len = k.k AND x.phrase = array_to_string(w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.len = k.len - k.k AND y.phrase = array_to_string(w[k.k + 1:k.len], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM s),
inside AS (SELECT c.lang, array_to_string(c.w[t.i:t.i + t.m - 1], ' ') AS phrase, max(c.a) AS a FROM c, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) t(i, m) WHERE t.m < c.len AND t.i + t.m - 1 <= c.len GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN inside USING (lang, phrase) WHERE first = 1 AND (inside.a IS NULL OR 100 * CAST(inside.a AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {
    "op2_pivot_top_k": TOP_K,
    "op4_projection_forest": VECTORS,
    "op6_fingerprint_index": SUBSTRINGS,
    "op7_coordinate_join": NEAR_DUPLICATES,
    "op10_grammar_round_trip": CHATS,
    "op11_positional_lists": PHRASES,
}
