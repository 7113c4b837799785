"""DuckDB SQL of the operator queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

# formatted_chars: each block has <|turn|> role \n ... <|done|>\n (8 + 1 + 9), each further turn <|also|> (8),
# and each < + backslashes + | in a text or role one backslash more; a line break in a role becomes 8 characters
SQL["op5_chat_format"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars,
    length(role) + len(regexp_extract_all(role, '<\\*\|')) + 7 * (length(role) - length(replace(role, chr(10), ''))) AS role_chars,
    before IS NULL OR before <> role AS opens
  FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN opens THEN 18 + role_chars ELSE 8 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

SQL["op10_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

SQL["op7_decontaminate"] = r"""
WITH t AS (
  SELECT doc_id AS id, FALSE AS item, text FROM documents UNION ALL SELECT item_id, TRUE, text FROM benchmark
), w AS (
  SELECT id, item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT DISTINCT id, item, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM w WHERE len(w) >= 5
), n AS (
  SELECT id AS item_id, count(*) AS n FROM s WHERE item GROUP BY id
), b AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM s d JOIN s i ON d.s = i.s AND i.item AND NOT d.item GROUP BY ALL
)
SELECT doc_id, item_id, n::BIGINT AS n_shingles, k::BIGINT AS n_shared, k::DOUBLE / n AS containment
FROM b JOIN n USING (item_id) WHERE 10 * k >= 8 * n
"""

# components: labels fall along links until nothing changes; 1000 documents need few steps
SQL["op1_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

# the first four 8-digit groups of a hex digest as numbers
_HASHES = """list_transform(range(0, 4), lambda i: list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
      lambda j: (strpos('0123456789abcdef', d[8 * i + j]) - 1)::BIGINT)), lambda x, y: 16 * x + y))"""

SQL["op13_infill"] = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents
), h AS (
  SELECT *, len(w) AS n, {_HASHES} AS h FROM t
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, n, form, text, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
    array_to_string(w[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

# clamped sources are the first ones by cap / weight; the cuts of a source follow class by class, longest documents first
SQL["op11_source_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS m FROM documents
), r AS (
  SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class,
    256 * (strpos('0123456789abcdef', m[1]) - 1) + 16 * (strpos('0123456789abcdef', m[2]) - 1) + strpos('0123456789abcdef', m[3]) - 1 AS place FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM r GROUP BY source
), o AS (
  SELECT *, 0.75::DOUBLE * sum(cap) OVER () AS goal, sum(weight) OVER () AS weights,
    coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before
  FROM s WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, cap * (weights - weight_before) <= weight * (goal - cap_before) AS clamped FROM o
), g AS (
  SELECT *, sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS given, sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () AS open FROM c
), t AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE weight * (goal - given) / open END AS target FROM g
), f AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN (target - floor(target / source_size) * source_size) / source_size ELSE 0 END AS fraction FROM t
), h AS (
  SELECT source, class, place, sum(size)::BIGINT AS words FROM r GROUP BY ALL
), k AS (
  SELECT source, class, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS step,
    sum(sum(words)) OVER (PARTITION BY source ORDER BY class DESC) AS seen FROM h GROUP BY source, class
), e AS (
  SELECT source, class, 0 AS cut, 0 AS sums FROM k
  UNION ALL SELECT source, class, place + 1, sum(words) OVER (PARTITION BY source, class ORDER BY place) FROM h
), x AS (
  SELECT e.source, e.class, k.step, k.seen, e.cut, e.sums::BIGINT AS sums, f.fraction FROM e
  JOIN k ON k.source IS NOT DISTINCT FROM e.source AND k.class = e.class JOIN f ON f.source IS NOT DISTINCT FROM e.source
), q(source, step, class, taken, cut) AS (
  SELECT source, 0::BIGINT, -1, 0::BIGINT, 0 FROM f
  UNION ALL
  SELECT q.source, q.step + 1, any_value(x.class), arg_min(q.taken + x.sums, [abs(x.fraction * x.seen - (q.taken + x.sums)), x.cut]),
    arg_min(x.cut, [abs(x.fraction * x.seen - (q.taken + x.sums)), x.cut])
  FROM q JOIN x ON x.source IS NOT DISTINCT FROM q.source AND x.step = q.step + 1 GROUP BY q.source, q.step
)
SELECT r.doc_id, r.size, f.source_size, f.target::DOUBLE AS target, (r.size * (f.whole + CASE WHEN r.place < q.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN f ON f.source IS NOT DISTINCT FROM r.source JOIN q ON q.source IS NOT DISTINCT FROM r.source AND q.class = r.class
"""

_TERMS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

SQL["op12_lexical_search"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents
), g AS (
  SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d
), i AS (
  SELECT row_number() OVER () AS item, item_id, {_TERMS} AS w FROM benchmark
), q AS (
  SELECT DISTINCT item, item_id, unnest(w) AS term FROM i
), p AS (
  SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d
), t AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf FROM p SEMI JOIN q USING (term) GROUP BY row, term
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, g GROUP BY term
), s AS (
  SELECT q.item, q.item_id, t.row, any_value(t.doc_id) AS doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * t.n * g.n_docs) // g.n_words))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY q.item, q.item_id, t.row
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
