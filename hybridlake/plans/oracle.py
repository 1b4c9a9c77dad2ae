"""DuckDB SQL oracles for the registered queries.

Each string is plain SQL over the pre-registered views (documents, embeddings,
benchmark, conversations, labels, ...). They restate the operator definitions
directly (RE2 has no look-behind, so the newline step uses a placeholder), so
they are an independent check of the Spark plans, not a copy of them.
"""

from __future__ import annotations

from hybridlake import params as P
from hybridlake.plans.corpus import IVF
from hybridlake.plans.driver import DELETE_NAME, HISTORY_N, LIST_LIMIT, LIST_OFFSET, ONE_ID, PAGE_CHUNKS

DIM = 64
K = P.SEARCH_TOP_K[2]
K_RAG = P.QUERY_TOP_K[2]
SIZE, STEP = P.DEFAULT_CHUNK_SIZE, P.DEFAULT_CHUNK_SIZE - P.DEFAULT_CHUNK_OVERLAP


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    s = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_]+)-\n([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    s = rf"regexp_replace({s}, '\n{{2,}}', chr(1), 'g')"
    s = rf"regexp_replace({s}, '\n', ' ', 'g')"
    s = f"replace({s}, chr(1), chr(10))"
    s = rf"regexp_replace({s}, '[ \t]+', ' ', 'g')"
    ws = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
    return f"regexp_replace({s}, '^{ws}+|{ws}+\\z', '', 'g')"


# Marks inside a word, each with a character that stands for it while words are taken.
_MIDS = {"'": "\ue000", "\u2019": "\ue001", ".": "\ue002", ":": "\ue003", "\u00b7": "\ue004", ",": "\ue005", ";": "\ue006"}


def terms(x: str) -> str:
    """Words: letters, digits, marks and ``_``, with the marks of ``_MIDS`` where they stand between two letters
    (all but comma and semicolon) or two digits (all but colon and middle dot). Twice, as neighbours overlap."""
    s = rf"regexp_replace(lower({x}), '([\p{{Han}}\p{{Hiragana}}]\p{{M}}*)', ' \1 ', 'g')"
    for mid, place in _MIDS.items():
        for before, after, others in ((r"[\p{L}\p{M}]", r"\p{L}", ",;"), (r"\p{N}", r"\p{N}", ":\u00b7")):
            if mid not in others:
                for _ in range(2):
                    s = f"regexp_replace({s}, {lit(f'({before})[{mid}]({after})')}, '\\1{place}\\2', 'g')"
    found = rf"regexp_extract_all({s}, '_*[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}_\x{{E000}}-\x{{E006}}]*')"
    back = "t"
    for mid, place in _MIDS.items():
        back = f"replace({back}, '{place}', {lit(mid)})"
    return f"list_transform({found}, lambda t: {back})"


DOCS = ("docs AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, text "
        "FROM documents)")


def chunk_ctes(src: str = "docs", name: str = "chunks", extra: str = "") -> str:
    """Records of an extracted-documents CTE (doc_id, path, text): clean once,
    then the chunker cleans again and windows the single-space tokens."""
    return f"""
{name}_src AS (SELECT doc_id{extra}, replace(path, '.pdf', '') AS document_name,
    string_split({clean(clean('text'))}, ' ') AS toks FROM {src}),
{name}_pos AS (SELECT doc_id{extra}, document_name, toks, unnest(range(0, len(toks), {STEP})) AS s FROM {name}_src),
{name} AS (SELECT doc_id{extra}, document_name || '_' || CAST(s // {STEP} AS VARCHAR) AS chunk_id, document_name,
    CAST(s // {STEP} AS INTEGER) AS chunk_index, array_to_string(list_slice(toks, s + 1, s + {SIZE}), ' ') AS text
    FROM {name}_pos)"""


def hash_vectors(src: str, key: str, text: str, name: str) -> str:
    """Sparse hashed vectors (key, b, v): md5 bucket = first 8 hex digits mod
    dim, sign + when the 9th hex digit < 8; L2-normalised; stored as float."""
    return f"""
{name}_t AS (SELECT {key}, unnest({terms(text)}) AS term FROM {src}),
{name}_c AS (SELECT {key}, CAST(CAST('0x' || substr(md5(term), 1, 8) AS UBIGINT) % {DIM} AS INTEGER) AS b,
    CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS INTEGER) < 8 THEN 1 ELSE -1 END AS sg FROM {name}_t),
{name}_s AS (SELECT {key}, b, SUM(sg) AS c FROM {name}_c GROUP BY {key}, b),
{name}_n AS (SELECT {key}, sqrt(SUM(c * c)) AS nrm FROM {name}_s GROUP BY {key}),
{name} AS (SELECT {key}, b, CAST(CAST(c / nrm AS FLOAT) AS DOUBLE) AS v FROM {name}_s JOIN {name}_n USING ({key})
    WHERE c <> 0)"""


def knn_ctes(qsrc: str, qv: str, csrc: str, cv: str, cid: str, space: str, k: int, name: str) -> str:
    """Exact top-k of sparse query vectors ``qv(qid,b,v)`` against ``cv(cid,b,v)``.

    ``qsrc(qid)`` / ``csrc(cid)`` list every query / record: one without terms
    has a zero vector (no cosine; an L2 distance all the same).
    """
    if space == "l2":
        score = "1.0 / (1.0 + greatest(qn2 + vn2 - 2.0 * dot, 0.0))"
        where = "TRUE"
    else:
        score = "(1.0 + dot / (sqrt(qn2) * sqrt(vn2))) / 2.0"
        where = "qn2 > 0 AND vn2 > 0"
    return f"""
{name}_qn AS (SELECT q.qid, COALESCE(SUM(v.v * v.v), 0.0) AS qn2 FROM {qsrc} q LEFT JOIN {qv} v USING (qid)
    GROUP BY q.qid),
{name}_vn AS (SELECT c.{cid}, COALESCE(SUM(v.v * v.v), 0.0) AS vn2 FROM {csrc} c LEFT JOIN {cv} v USING ({cid})
    GROUP BY c.{cid}),
{name}_dot AS (SELECT q.qid, c.{cid}, SUM(q.v * c.v) AS dot FROM {qv} q JOIN {cv} c USING (b) GROUP BY q.qid, c.{cid}),
{name}_all AS (SELECT a.qid, b.{cid}, ({score.replace('dot', 'COALESCE(d.dot, 0.0)')}) AS score
    FROM {name}_qn a CROSS JOIN {name}_vn b LEFT JOIN {name}_dot d ON d.qid = a.qid AND d.{cid} = b.{cid}
    WHERE {where}),
{name} AS (SELECT qid, {cid}, score,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {cid}) AS rank
    FROM {name}_all QUALIFY rank <= {k})"""


def ivf_ctes(qsrc: str, qv: str, csrc: str, cv: str, cid: str, k: int, name: str) -> str:
    """Top-k by L2 of the records in each query's ``nprobe`` nearest cells.

    The centroids are the ``n_cells`` records whose ids have the smallest md5; a
    record's cell is its nearest centroid. ``{name}_all``, ``{name}_qn`` and
    ``{name}_vn`` are those of ``knn_ctes``.
    """
    return knn_ctes(qsrc, qv, csrc, cv, cid, "l2", k, f"{name}x") + f""",
{name}_ct AS (SELECT {cid} AS center, row_number() OVER (ORDER BY md5(CAST({cid} AS VARCHAR)), {cid}) - 1 AS cell FROM {csrc}
    QUALIFY cell < {IVF.n_cells}),
{name}_cn AS (SELECT cell, center, vn2 AS cn2 FROM {name}_ct JOIN {name}x_vn v ON v.{cid} = center),
{name}_cd AS (SELECT c.{cid}, cell, SUM(c.v * m.v) AS dot FROM {cv} c JOIN {cv} m USING (b) JOIN {name}_ct ON center = m.{cid}
    GROUP BY c.{cid}, cell),
{name}_cells AS (SELECT a.{cid}, n.cell FROM {name}x_vn a CROSS JOIN {name}_cn n
    LEFT JOIN {name}_cd d ON d.{cid} = a.{cid} AND d.cell = n.cell
    QUALIFY row_number() OVER (PARTITION BY a.{cid} ORDER BY round(vn2 + cn2 - 2.0 * COALESCE(dot, 0.0), 9), n.cell) = 1),
{name}_qd AS (SELECT q.qid, cell, SUM(q.v * m.v) AS dot FROM {qv} q JOIN {cv} m USING (b) JOIN {name}_ct ON center = m.{cid}
    GROUP BY q.qid, cell),
{name}_probes AS (SELECT a.qid, n.cell FROM {name}x_qn a CROSS JOIN {name}_cn n
    LEFT JOIN {name}_qd d ON d.qid = a.qid AND d.cell = n.cell
    QUALIFY row_number() OVER (PARTITION BY a.qid ORDER BY round(qn2 + cn2 - 2.0 * COALESCE(dot, 0.0), 9), n.cell) <= {IVF.nprobe}),
{name} AS (SELECT a.qid, a.{cid}, score, row_number() OVER (PARTITION BY a.qid ORDER BY round(score, 9) DESC, a.{cid}) AS rank
    FROM {name}x_all a JOIN {name}_cells c ON c.{cid} = a.{cid} JOIN {name}_probes p ON p.qid = a.qid AND p.cell = c.cell
    QUALIFY rank <= {k})"""


def bm25_ctes(qsrc: str, k: int, name: str = "kw") -> str:
    """BM25 (k1 1.2, b 0.75) of ``qsrc(qid, text)`` over ``chunks`` plus top-k."""
    return f"""
ct AS (SELECT chunk_id, {terms('text')} AS terms FROM chunks),
post AS (SELECT term, chunk_id, CAST(count(*) AS INTEGER) AS tf, dl
    FROM (SELECT chunk_id, CAST(len(terms) AS INTEGER) AS dl, unnest(terms) AS term FROM ct) GROUP BY term, chunk_id, dl),
ts AS (SELECT term, count(*) AS df FROM post GROUP BY term),
cs AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avgdl FROM ct),
{name}_qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({terms('text')}) AS term FROM {qsrc})
    GROUP BY qid, term),
{name}_all AS (SELECT qid, chunk_id,
    SUM(qtf * ln(1.0 + (CAST(n_docs AS DOUBLE) - df + 0.5) / (df + 0.5)) * tf
        / (tf + 1.2 * (0.25 + 0.75 * CAST(dl AS DOUBLE) / avgdl))) AS score
    FROM {name}_qt JOIN ts USING (term) JOIN post USING (term) CROSS JOIN cs GROUP BY qid, chunk_id),
{name} AS (SELECT qid, chunk_id, score,
    row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM {name}_all QUALIFY rank <= {k})"""


def minmax(src: str, name: str) -> str:
    """Min-max per query over scores rounded to 9 decimals (max = min -> 1)."""
    return f"""
{name}_r AS (SELECT *, round(score, 9) AS rs FROM {src}),
{name} AS (SELECT * EXCLUDE (rs), CASE WHEN max(rs) OVER w = min(rs) OVER w THEN 1.0
    ELSE (rs - min(rs) OVER w) / (max(rs) OVER w - min(rs) OVER w) END AS norm
    FROM {name}_r WINDOW w AS (PARTITION BY qid))"""


def hybrid_ctes(qsrc: str, k: int, normalized: bool = True, ivf: bool = False) -> str:
    """Keyword and L2 vector legs over ``chunks`` for ``qsrc(qid, text)``, fused."""
    kcol, vcol = ("norm", "norm") if normalized else ("score", "score")
    return ",".join([
        bm25_ctes(qsrc, k, "kw"),
        hash_vectors(qsrc, "qid", "text", "qv"),
        hash_vectors("chunks", "chunk_id", "text", "cv"),
        ivf_ctes(qsrc, "qv", "chunks", "cv", "chunk_id", k, "vl") if ivf
        else knn_ctes(qsrc, "qv", "chunks", "cv", "chunk_id", "l2", k, "vl"),
        minmax("kw", "kwn"),
        minmax("vl", "vln"),
        f"""
fused_all AS (SELECT COALESCE(a.qid, b.qid) AS qid, COALESCE(a.chunk_id, b.chunk_id) AS chunk_id,
    a.{kcol} AS keyword_score, b.{vcol} AS vector_score,
    (0.3 * COALESCE(a.{kcol}, 0.0) + 0.7 * COALESCE(b.{vcol}, 0.0)) / (CAST(0.3 AS DOUBLE) + CAST(0.7 AS DOUBLE)) AS score
    FROM kwn a FULL OUTER JOIN vln b ON a.qid = b.qid AND a.chunk_id = b.chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
    FROM fused_all QUALIFY rank <= {k})""",
    ])


BENCH_Q = "bq AS (SELECT item_id AS qid, text FROM benchmark)"
CHUNKS = f"{DOCS},{chunk_ctes()}"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def context_agg(hits: str, first_label: int) -> str:
    line = (f"'Document ' || CAST(rank - 1 + {first_label} AS VARCHAR) || ':' || chr(10) || COALESCE(text, '') "
            "|| chr(10) || chr(10)")
    return f"""SELECT qid, string_agg({line}, '' ORDER BY rank) AS context FROM {hits} GROUP BY qid"""


HIT_TEXT = ("hit_text AS (SELECT f.*, c.text, c.document_name, c.doc_id FROM fused f LEFT JOIN chunks c USING (chunk_id))")
ROLE_LINE = ("CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || COALESCE(text, '') || chr(10)")
HISTORY = f"""hist AS (SELECT conv_id, turn, role, text,
    COALESCE(array_to_string(list({ROLE_LINE} ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN {HISTORY_N} PRECEDING AND 1 PRECEDING), ''), '') AS history FROM conversations)"""
HISTORY_BLOCK = f"CASE WHEN history <> '' THEN {lit(P.HISTORY_HEADER)} || history || chr(10) ELSE '' END"


def chat_prompt_sql(ctx: str, query: str, history: str = HISTORY_BLOCK) -> str:
    return (f"{lit(P.DEFAULT_PREAMBLE)} || CASE WHEN COALESCE({ctx}, '') <> '' THEN {lit(P.CONTEXT_INTRO)} || {ctx} "
            f"|| chr(10) ELSE {lit(P.NO_CONTEXT_LINE)} END || {history} || 'User: ' || {query} || chr(10) || 'Assistant:'")


PAGES = """pg AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS document_name, turn, role, text FROM conversations)"""
USER_Q = "uq AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, conv_id, turn, text, history FROM hist WHERE role = 'user')"
REVISIONS = ("rev AS (SELECT d.doc_id, d.text || ' [quality=' || CAST(l.quality AS VARCHAR) || ' toxic=' "
             "|| CAST(l.toxic AS VARCHAR) || ']' AS text, d.source FROM documents d JOIN labels l USING (doc_id))")


def _r(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c.split('.')[-1]}"


SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "chunk_text": f"""WITH s AS (SELECT doc_id, string_split({clean('text')}, ' ') AS toks FROM documents),
p AS (SELECT doc_id, toks, unnest(range(0, len(toks), {STEP})) AS st FROM s)
SELECT doc_id, CAST(st // {STEP} AS INTEGER) AS chunk_index,
    array_to_string(list_slice(toks, st + 1, st + {SIZE}), ' ') AS chunk FROM p""",
    "chunk_records": with_(CHUNKS) + "SELECT chunk_id, document_name, chunk_index, text FROM chunks",
    "analyze_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM documents) GROUP BY term",
    "page_assembly": with_(PAGES) + f"""SELECT document_name, {clean("string_agg(CASE WHEN text = '' THEN '' "
        "WHEN role = 'system' THEN array_to_string([text, NULL], '') ELSE text END, '' ORDER BY turn)")} AS text
    FROM pg GROUP BY document_name""",
    "page_concat_plain": with_(PAGES) + """SELECT document_name, string_agg(CASE WHEN role = 'system' THEN ''
    ELSE text END, '' ORDER BY turn) AS text FROM pg GROUP BY document_name""",
    "postings": with_(CHUNKS, BENCH_Q, bm25_ctes("bq", K)) + "SELECT term, chunk_id, tf, dl FROM post",
    "term_stats": with_(CHUNKS, BENCH_Q, bm25_ctes("bq", K)) + "SELECT term, df FROM ts",
    "corpus_stats": with_(CHUNKS, BENCH_Q, bm25_ctes("bq", K)) + f"SELECT n_docs, {_r('avgdl')} FROM cs",
    "keyword_search": with_(CHUNKS, BENCH_Q, bm25_ctes("bq", K)) + f"SELECT qid, chunk_id, {_r('score')}, rank FROM kw",
    "minmax_scores": with_(CHUNKS, BENCH_Q, bm25_ctes("bq", K), minmax("kw", "kwn"))
    + f"SELECT qid, chunk_id, {_r('score')}, {_r('norm')}, rank FROM kwn",
    "hybrid_search": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K))
    + f"SELECT qid, chunk_id, {_r('keyword_score')}, {_r('vector_score')}, {_r('score')}, rank FROM fused",
    "hybrid_ivf": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K, ivf=True))
    + f"SELECT qid, chunk_id, {_r('keyword_score')}, {_r('vector_score')}, {_r('score')}, rank FROM fused",
    "hybrid_raw": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K, normalized=False))
    + f"SELECT qid, chunk_id, {_r('keyword_score')}, {_r('vector_score')}, {_r('score')}, rank FROM fused",
    "search_hits": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K), HIT_TEXT)
    + f"""SELECT h.qid, h.rank, h.chunk_id, h.document_name, COALESCE(h.text, '') AS text, {_r('score')},
    CAST(2 AS INTEGER) AS metadata_size, d.source, d.lang,
    count(*) OVER (PARTITION BY h.qid) AS total, substr(COALESCE(h.text, ''), 1, 200) || '...' AS preview,
    round(score, 3) AS score_3 FROM hit_text h LEFT JOIN documents d USING (doc_id)""",
    "request_validation": f"""SELECT CASE WHEN item_id BETWEEN {P.SEARCH_TOP_K[0]} AND {P.SEARCH_TOP_K[1]}
    THEN 'accepted' ELSE 'rejected' END AS status,
    CASE WHEN item_id BETWEEN {P.SEARCH_TOP_K[0]} AND {P.SEARCH_TOP_K[1]} THEN NULL ELSE 'top_k_out_of_range' END AS reason,
    count(*) AS n FROM benchmark GROUP BY ALL""",
    "query_request_validation": f"""SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
    reason, count(*) AS n FROM (SELECT CASE
        WHEN NOT (ceil(item_id / 20) BETWEEN {P.QUERY_TOP_K[0]} AND {P.QUERY_TOP_K[1]}) THEN 'top_k_out_of_range'
        WHEN NOT (item_id / 10.0 BETWEEN {P.TEMPERATURE[0]} AND {P.TEMPERATURE[1]}) THEN 'temperature_out_of_range'
    END AS reason FROM benchmark) GROUP BY ALL""",
    "delete_report": f"""SELECT count(*) FILTER (WHERE source IS NOT DISTINCT FROM {lit(DELETE_NAME)}) AS deleted,
    count(*) FILTER (WHERE source IS DISTINCT FROM {lit(DELETE_NAME)}) AS remaining FROM documents""",
    "text_preview": f"""SELECT doc_id, CAST(length(t) AS INTEGER) AS text_length, substr(t, 1, 500) || '...' AS preview
    FROM (SELECT doc_id, {clean('text')} AS t FROM documents)""",
    "ingest_report": f"""SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS n
FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing_id' WHEN d.text IS NULL THEN 'missing_text'
    WHEN e.embedding IS NULL OR d.doc_id % 7 = 0 OR len(e.embedding) <> {DIM} THEN 'bad_dimension' END AS reason
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) GROUP BY ALL""",
    "upsert_latest": with_(REVISIONS, """u AS (SELECT doc_id, text, source, 0 AS batch, doc_id AS seq FROM documents
    UNION ALL SELECT doc_id, text, source, 1 AS batch, doc_id AS seq FROM rev)""")
    + """SELECT doc_id, text, source, CAST(batch AS BIGINT) AS batch FROM u
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch DESC, seq DESC) = 1""",
    "upsert_in_batch_duplicates": "SELECT doc_id, text || ' v3' AS text, source, CAST(3 AS BIGINT) AS version FROM documents",
    "streaming_in_batch_duplicates": "SELECT doc_id, source, CAST(2 AS INTEGER) AS version FROM documents",
    "prefixed_embedding": with_(f"pd AS (SELECT doc_id, {lit(P.PASSAGE_PREFIX)} || text AS text FROM documents)",
                                hash_vectors("pd", "doc_id", "text", "pv").lstrip())
    + "SELECT doc_id, b AS dim_index, round(v, 6) AS value FROM pv",
    "delete_by_id": """SELECT d.doc_id, d.source FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "delete_by_name": f"SELECT doc_id, source AS document_name FROM documents WHERE source IS DISTINCT FROM {lit(DELETE_NAME)}",
    "list_documents": with_(CHUNKS) + f"SELECT chunk_id, text FROM chunks ORDER BY chunk_id LIMIT {LIST_LIMIT} OFFSET {LIST_OFFSET}",
    "list_documents_deep": with_(CHUNKS) + f"""SELECT chunk_id, text FROM (SELECT chunk_id, text, row_number() OVER (ORDER BY chunk_id)
    - 1 AS place, count(*) OVER () AS n FROM chunks) WHERE place >= n // 2 AND place < n // 2 + {LIST_LIMIT}""",
    "document_count": with_(CHUNKS) + "SELECT count(*) AS n FROM chunks",
    "sample_document": with_(CHUNKS) + "SELECT chunk_id, document_name, chunk_index, text FROM chunks ORDER BY chunk_id LIMIT 1",
    "hash_embedding": with_(CHUNKS, hash_vectors("chunks", "chunk_id", "text", "cv").lstrip())
    + "SELECT chunk_id, b AS dim_index, round(v, 6) AS value FROM cv",
    "embedding_preview": with_(hash_vectors("documents", "doc_id", "text", "dv").lstrip())
    + f"SELECT d.doc_id, CAST({DIM} AS INTEGER) AS embedding_dimension, "
    + ", ".join(f"round(COALESCE(max(CASE WHEN b = {i} THEN v END), 0.0), 6) AS e{i}" for i in range(10))
    + " FROM documents d LEFT JOIN dv USING (doc_id) GROUP BY d.doc_id",
    "context_blocks": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K), HIT_TEXT) + context_agg("hit_text", 0),
    "history_window": with_(HISTORY) + "SELECT conv_id, turn, history FROM hist",
    "chat_prompts": with_(HISTORY) + f"SELECT conv_id, turn, {chat_prompt_sql(lit(''), 'text')} AS prompt "
    "FROM hist WHERE role = 'user'",
    "qa_prompts": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K), HIT_TEXT, f"ctx AS ({context_agg('hit_text', 1)})")
    + f"SELECT b.qid, {lit(P.TUTORIAL_PROMPT_HEAD)} || COALESCE(c.context, '') || {lit(P.TUTORIAL_QUESTION)} "
    f"|| b.text || {lit(P.TUTORIAL_ANSWER)} AS prompt FROM bq b LEFT JOIN ctx c USING (qid)",
    "prompt_preview": with_(CHUNKS, BENCH_Q, hybrid_ctes("bq", K), HIT_TEXT, f"ctx AS ({context_agg('hit_text', 1)})",
        f"qa AS (SELECT b.qid, {lit(P.TUTORIAL_PROMPT_HEAD)} || COALESCE(c.context, '') || {lit(P.TUTORIAL_QUESTION)} "
        f"|| b.text || {lit(P.TUTORIAL_ANSWER)} AS prompt FROM bq b LEFT JOIN ctx c USING (qid))")
    + "SELECT qid, CAST(length(prompt) AS INTEGER) AS prompt_length, substr(prompt, 1, 200) || '...' AS preview FROM qa",
    "rag_prompts": with_(CHUNKS, HISTORY, USER_Q, hybrid_ctes("uq", K_RAG), HIT_TEXT,
                         f"ctx AS ({context_agg('hit_text', 0)})")
    + f"SELECT u.conv_id, u.turn, {chat_prompt_sql('c.context', 'u.text')} AS prompt FROM uq u LEFT JOIN ctx c USING (qid)",
    "answer_assembly": """SELECT conv_id AS answer_id,
    COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS answer
    FROM conversations GROUP BY conv_id""",
    "streaming_ingest": with_(
        DOCS, REVISIONS,
        "revdocs AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, text FROM rev)",
        chunk_ctes("docs", "c0").lstrip(), chunk_ctes("revdocs", "c1").lstrip(),
        "u AS (SELECT *, 0 AS batch FROM c0 UNION ALL SELECT *, 1 AS batch FROM c1)")
    + """SELECT chunk_id, document_name, chunk_index, text FROM u
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY batch DESC) = 1""",
}

# Requests with their own top_k: each leg's first top_k hits, fused.
_WIDE = hybrid_ctes("bq", P.SEARCH_TOP_K[1])
for _leg in ("kw", "vl"):
    _WIDE = _WIDE.replace(f"AS rs FROM {_leg})", f"AS rs FROM (SELECT l.* FROM {_leg} l JOIN bq USING (qid) WHERE rank <= top_k))")
SQL["search_requests"] = with_(
    CHUNKS, f"asked AS (SELECT item_id AS qid, text, CASE WHEN item_id % 25 = 7 THEN {P.SEARCH_TOP_K[2]} ELSE item_id % 25 END "
    "AS top_k FROM benchmark)",
    f"bq AS (SELECT * FROM asked WHERE top_k BETWEEN {P.SEARCH_TOP_K[0]} AND {P.SEARCH_TOP_K[1]})", _WIDE) + f"""
    SELECT qid, chunk_id, {_r('score')}, rank, '' AS reason FROM fused JOIN bq USING (qid) WHERE rank <= top_k
    UNION ALL SELECT qid, '', 0.0, 0, 'top_k_out_of_range' FROM asked
    WHERE NOT top_k BETWEEN {P.SEARCH_TOP_K[0]} AND {P.SEARCH_TOP_K[1]}"""

# Searches over an updated index: the same search over the final state.
_UPDATED = with_(
    DOCS, REVISIONS, "revdocs AS (SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.pdf' AS path, text FROM rev)",
    chunk_ctes("docs", "c0").lstrip(), chunk_ctes("revdocs", "c1").lstrip(),
    "chunks AS (SELECT * FROM c1 UNION ALL SELECT * FROM c0 WHERE chunk_id NOT IN (SELECT chunk_id FROM c1))",
    BENCH_Q, hybrid_ctes("bq", K))
_DELETED = with_(DOCS, chunk_ctes("docs", "c0").lstrip(),
                 f"chunks AS (SELECT * FROM c0 WHERE NOT starts_with(document_name, {lit(DELETE_NAME + '/')}))",
                 BENCH_Q, hybrid_ctes("bq", K))
# the second version of every revised document is the one that counts
_SECOND = _UPDATED.replace("'.pdf' AS path, text FROM rev)", "'.pdf' AS path, text || ' version 2' AS text FROM rev)")
_ONE = with_(DOCS, chunk_ctes("docs", "c0").lstrip(), f"""chunks AS (SELECT * FROM c0 UNION ALL
    SELECT NULL, {lit(ONE_ID)}, 'one', 0, (SELECT min_by(text, item_id) FROM benchmark))""", BENCH_Q, hybrid_ctes("bq", K))
for _key, _state in (("search_after_upsert", _UPDATED), ("search_after_stream", _UPDATED), ("search_after_delete", _DELETED),
                     ("search_after_deletes", _DELETED), ("search_after_two_streams", _SECOND),
                     ("update_in_batch_duplicates", _SECOND), ("index_one_search", _ONE)):
    SQL[_key] = _state + (f"SELECT qid, chunk_id, {_r('keyword_score')}, {_r('vector_score')}, {_r('score')}, rank FROM fused")

# Exact search through the IVF index with every cell probed equals exact kNN.
_CLEAN = "clean AS (SELECT * FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0)"
_GIVEN = "ev AS (SELECT vec_id, unnest(range(len(embedding))) AS b, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
for _key, _space in (("knn_l2", "l2"), ("knn_cosine", "cosine"), ("knn_ivf_all_cells", "l2")):
    SQL[_key] = (with_(BENCH_Q, hash_vectors("bq", "qid", "text", "qv").lstrip(), _GIVEN,
                       knn_ctes("bq", "qv", "embeddings", "ev", "vec_id", _space, K, "nn").lstrip())
                 + f"SELECT qid, vec_id, {_r('score')}, rank FROM nn")

# A page begins at the number of tokens of all that comes before it.
_TWICE = lambda x: clean(clean(x))
_PAGE_TEXT = "CASE WHEN text = '' THEN '' WHEN role = 'system' THEN array_to_string([text, NULL], '') ELSE text END"
SQL["ingest_pages"] = f"""WITH pt AS (SELECT 'conv-' || CAST(conv_id AS VARCHAR) AS document_name, turn, {_PAGE_TEXT} AS t
    FROM conversations),
pre AS (SELECT document_name, turn, COALESCE(string_agg(t, '' ORDER BY turn) OVER (PARTITION BY document_name ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM pt),
begins AS (SELECT document_name, turn, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS first
    FROM (SELECT document_name, turn, {_TWICE('before')} AS c FROM pre)),
whole AS (SELECT document_name, count(*) AS n_pages, string_split({_TWICE("string_agg(t, '' ORDER BY turn)")}, ' ') AS toks FROM pt
    GROUP BY document_name),
pos AS (SELECT document_name, n_pages, toks, unnest(range(0, len(toks), {PAGE_CHUNKS.step})) AS s FROM whole)
SELECT p.document_name || '_' || CAST(s // {PAGE_CHUNKS.step} AS VARCHAR) AS chunk_id, p.document_name,
    CAST(CASE WHEN toks = [''] THEN NULL ELSE (SELECT max(turn) FROM begins b WHERE b.document_name = p.document_name
        AND b.first <= s) END AS INTEGER) AS page_number,
    CAST(s // {PAGE_CHUNKS.step} AS INTEGER) AS chunk_index,
    array_to_string(list_slice(toks, s + 1, s + {PAGE_CHUNKS.chunk_size}), ' ') AS text, CAST(n_pages AS VARCHAR) AS n_pages,
    '2024-01-01' AS created_on, CAST({DIM} AS INTEGER) AS embedding_dimension FROM pos p"""

SQL["index_lifecycle"] = with_(CHUNKS) + """SELECT 'records' AS step, count(*) AS n FROM chunks
    UNION ALL SELECT 'dropped', 1 UNION ALL SELECT 'dropped again', 0"""
SQL["answer_stream"] = SQL["answer_assembly"].replace("AS answer\n", "AS answer, TRUE AS complete\n")

for _key in ("knn_ivf", "knn_ivf_routed"):
    SQL[_key] = (with_(BENCH_Q, hash_vectors("bq", "qid", "text", "qv").lstrip(), _GIVEN,
                       ivf_ctes("bq", "qv", "embeddings", "ev", "vec_id", K, "nn").lstrip())
                 + f"SELECT qid, vec_id, {_r('score')}, rank FROM nn")
for _key in ("keyword_search_scan", "keyword_search_blocks"):
    SQL[_key] = SQL["keyword_search"]

# Chat requests with their own top_k, temperature and switch.
_ASKED = f"""asked AS (SELECT qid, conv_id, turn, text, history,
    CASE WHEN conv_id % 5 <> 0 THEN conv_id % 12 ELSE {P.QUERY_TOP_K[2]} END AS top_k,
    CASE WHEN conv_id % 7 <> 0 THEN (conv_id % 25) / 10.0 ELSE {P.TEMPERATURE[2]} END AS temperature,
    CASE WHEN turn % 4 <> 1 THEN turn % 4 < 3 ELSE TRUE END AS use_rag FROM uq),
checked AS (SELECT *, CASE WHEN NOT top_k BETWEEN {P.QUERY_TOP_K[0]} AND {P.QUERY_TOP_K[1]} THEN 'top_k_out_of_range'
    WHEN NOT temperature BETWEEN {P.TEMPERATURE[0]} AND {P.TEMPERATURE[1]} THEN 'temperature_out_of_range' ELSE '' END AS reason
    FROM asked),
sq AS (SELECT * FROM checked WHERE reason = '' AND use_rag)"""
_MIXED = hybrid_ctes("sq", P.QUERY_TOP_K[1])
for _leg in ("kw", "vl"):
    _MIXED = _MIXED.replace(f"AS rs FROM {_leg})", f"AS rs FROM (SELECT l.* FROM {_leg} l JOIN sq USING (qid) WHERE rank <= top_k))")
SQL["rag_requests_mixed"] = with_(
    CHUNKS, HISTORY, USER_Q, _ASKED, _MIXED, HIT_TEXT,
    "own_hits AS (SELECT h.* FROM hit_text h JOIN sq USING (qid) WHERE rank <= top_k)", f"ctx AS ({context_agg('own_hits', 0)})") + f"""
    SELECT u.conv_id, u.turn, CAST(top_k AS INTEGER) AS top_k, round(CAST(temperature AS DOUBLE), 6) AS temperature,
    CASE WHEN reason = '' THEN {chat_prompt_sql('c.context', 'u.text')} ELSE '' END AS prompt, reason
    FROM checked u LEFT JOIN ctx c USING (qid)"""

_key = "knn_dirty_vectors"
SQL[_key] = (with_(BENCH_Q, hash_vectors("bq", "qid", "text", "qv").lstrip(), _CLEAN,
                   _GIVEN.replace("FROM embeddings", "FROM clean"),
                   knn_ctes("bq", "qv", "clean", "ev", "vec_id", "l2", K, "nn").lstrip())
             + f"SELECT qid, vec_id, {_r('score')}, rank FROM nn")
