"""DuckDB SQL for the registered queries that SQL can express.

The others need tokenizers, models learnt from data, XXH64 or a byte-wise
SHA-256, none of which DuckDB has; the tests hold them against brute force.
"""

from __future__ import annotations

from hybridlake.llm.centroid_clusters import ClusterParams
from hybridlake.llm.line_templates import TemplateParams
from hybridlake.llm.quality_rules import RepetitionRules

_R, _T, _C = RepetitionRules(), TemplateParams(), ClusterParams()
_WORD = r"'[^\x20\x09-\x0D]+'"


def _covered(width: int, name: str) -> str:
    """Number of words inside windows of ``width`` words that their text holds twice or more."""
    return f"""{name} AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
    SELECT doc_id, unnest(range(p, p + {width})) AS place FROM (
        SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, list_slice(ws, p, p + {width - 1})) AS times
        FROM places WHERE p + {width - 1} <= len(ws)) WHERE times > 1) GROUP BY doc_id)"""


OP4 = f"""WITH words AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), {_WORD}) AS ws
    FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM words),
{_covered(_R.window_words, "windows")},
{_covered(_R.repeat_words, "repeats")},
{_covered(_R.max_repeat_words + 1, "longest")},
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM words),
base AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(COALESCE(a.n, 0) AS BIGINT) AS n_repeat_words, COALESCE(b.n, 0) AS covered, COALESCE(c.n, 0) AS long
    FROM words w JOIN lines USING (doc_id) LEFT JOIN windows a USING (doc_id) LEFT JOIN repeats b USING (doc_id)
    LEFT JOIN longest c USING (doc_id)),
failed AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_window_percent} * n_words AS base_failed
    FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND covered <= {_R.max_covered} * n_words AND long = 0 AS kept FROM failed"""

# A line's template is its tokens with fields masked. Per distinct text; ``t`` tells texts apart.
OP7 = f"""WITH rows AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
texts AS (SELECT t, min(doc_id) AS first, string_split(t, chr(10)) AS ls FROM rows GROUP BY t),
numbered AS (SELECT t, first, unnest(ls) AS content, unnest(range(len(ls))) AS line FROM texts),
split AS (SELECT t, first, line, regexp_extract_all(content, {_WORD}) AS words FROM numbered),
lines AS (SELECT *, len(words) AS n, list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)
    AS masked FROM split WHERE len(words) >= {_T.min_tokens}),
templates AS (SELECT masked, n, [CAST(n AS VARCHAR)] || masked[1:{_T.leading}] AS leaf, count(DISTINCT t) AS texts,
    min(first) AS keeper FROM lines GROUP BY masked, n
    HAVING len(list_filter(masked, lambda x: x <> '<*>')) >= {_T.constant} * n),
holds AS (SELECT DISTINCT masked, t, first FROM lines),
forked AS (SELECT leaf FROM templates GROUP BY leaf HAVING count(*) > 1),
open AS (SELECT * FROM templates WHERE leaf IN (SELECT leaf FROM forked)),
places AS (SELECT leaf, masked, n, unnest(range(1, n + 1)) AS place FROM open),
but_one AS (SELECT leaf, masked, place, masked[1:place - 1] || ['?'] || masked[place + 1:n] AS rest FROM places
    WHERE len(list_filter(masked, lambda x: x <> '<*>')) - CAST(masked[place] <> '<*>' AS INT) >= {_T.constant} * n),
one_place AS (SELECT leaf, place, rest, min(first) AS keeper FROM but_one JOIN holds USING (masked)
    GROUP BY leaf, place, rest HAVING count(DISTINCT t) >= {_T.min_texts}),
fixed AS (SELECT leaf, place, masked[place] AS token FROM places JOIN holds USING (masked) WHERE masked[place] <> '<*>'
    GROUP BY leaf, place, masked[place] HAVING count(DISTINCT t) >= {_T.min_texts}),
shapes AS (SELECT p.leaf, p.masked, list(f.token ORDER BY p.place) AS shape FROM places p LEFT JOIN fixed f
    ON p.leaf = f.leaf AND p.place = f.place AND p.masked[p.place] = f.token GROUP BY p.leaf, p.masked, p.n
    HAVING count(f.token) >= {_T.constant} * p.n),
shared AS (SELECT leaf, shape, min(first) AS keeper FROM shapes JOIN holds USING (masked) GROUP BY leaf, shape
    HAVING count(DISTINCT t) >= {_T.min_texts}),
found AS (SELECT masked, min(keeper) AS keeper FROM (
    SELECT masked, keeper FROM templates WHERE texts >= {_T.min_texts}
    UNION ALL SELECT masked, o.keeper FROM but_one b JOIN one_place o ON b.leaf = o.leaf AND b.place = o.place AND b.rest = o.rest
    UNION ALL SELECT masked, s.keeper FROM shapes JOIN shared s USING (leaf, shape)) GROUP BY masked),
long AS (SELECT words, min(first) AS keeper FROM lines WHERE n >= {_T.long_tokens} GROUP BY words
    HAVING count(DISTINCT t) >= {_T.long_texts}),
lost AS (SELECT t, list(line) AS dropped FROM (
    SELECT t, line FROM lines JOIN found USING (masked) WHERE first IS DISTINCT FROM keeper
    UNION SELECT t, line FROM lines JOIN long USING (words) WHERE first IS DISTINCT FROM keeper) GROUP BY t)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines,
    CAST(COALESCE(len(dropped), 0) AS BIGINT) AS n_dropped,
    CASE WHEN dropped IS NULL THEN t ELSE array_to_string(
        list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(dropped, i)), lambda i: ls[i + 1]), chr(10)) END
    AS kept_text FROM rows JOIN texts USING (t) LEFT JOIN lost USING (t)"""



def _rounds() -> str:
    """Lloyd's rounds one after another: ``a<i>`` assigns with the centroids ``c<i>``, which make ``c<i + 1>``."""
    steps = []
    for i in range(_C.rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT k.*, m.c,
    list_sum(list_transform(range(1, {_C.dim + 1}), lambda j: (k.v[j] - m.v[j]) * (k.v[j] - m.v[j]))) AS d FROM kept k CROSS JOIN c{i} m)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < _C.rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT m.c, COALESCE(n.v, m.v) AS v FROM c{i} m LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
        SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({_C.dim})) AS j FROM a{i})
        GROUP BY c, j) GROUP BY c) n USING (c))""")
    return ",\n".join(steps)


OP11 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({_C.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {_C.dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {_C.dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{_C.seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM kept
    QUALIFY c < {_C.clusters}),
{_rounds()}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(m.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{_C.rounds} a JOIN c{_C.rounds} m USING (c)"""

SQL: dict[str, str] = {"op4_quality_rules": OP4, "op7_line_dedup": OP7, "op11_centroid_clusters": OP11}
