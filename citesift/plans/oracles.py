"""The registered queries in SQL, written independently of the Spark plans.

Every entry is a chain of named table expressions. They compute the same results the plain way:
all pairs, window functions, aggregates. That is right for a check at small scale and is not how the
operators work.
"""

from __future__ import annotations

from citesift.functions.prompts import INSTRUCTION, REFUSAL
from citesift.plans.registry import DECLARED_ROLES, FOLDS, KNN, REFUSED_LANGUAGE, TRIAL_WEIGHTS

WS = r"[\t-\r\x{1c}-\x20\x{85}\p{Z}]"
SEPARATOR = r"[\t-\r\x{1c}-\x20\x{85}\p{Z},;]+"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda x: x <> '')"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


DOCS = f"""
docs AS (
  SELECT * FROM (SELECT doc_id::varchar AS doc_id, source, {strip("text")} AS text FROM documents)
  WHERE text <> ''
)"""

CHUNKS = f"""{DOCS},
doc_words AS (SELECT doc_id, source, {words("text")} AS w FROM docs),
windows AS (
  SELECT *, len(w) AS n, ceil(len(w) / 160.0)::bigint AS nw FROM doc_words WHERE len(w) > 0
),
pieces AS (
  SELECT doc_id, source, w, i FROM (
    SELECT *, unnest(range(0, nw - CASE WHEN nw > 1 AND n <= (nw - 1) * 160 + 40 THEN 1 ELSE 0 END)) AS i
    FROM windows
  )
),
piece_text AS (
  SELECT doc_id, source, i, array_to_string(w[i * 160 + 1 : i * 160 + 200], ' ') AS text FROM pieces
),
chunks AS (
  SELECT doc_id || '#' || i || '-' || left(sha1(doc_id || ':' || i || ':' || text), 12) AS chunk_id,
         doc_id, source, i AS chunk_index, text
  FROM piece_text
)"""


def embedded(name: str, source: str, key: str, text: str) -> str:
    """Sparse unit vectors ``key, b, w`` of the hashed token counts."""
    return f"""
{name}_counts AS (
  SELECT {key}, ('0x' || left(md5(t), 8))::bigint % 256 AS b, count(*) AS c
  FROM (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}) GROUP BY ALL
),
{name} AS (
  SELECT {key}, b, (c / sqrt((sum(c * c) OVER (PARTITION BY {key}))::double))::float AS w FROM {name}_counts
)"""


CHUNK_VECTORS = embedded("cv", "chunks", "chunk_id", "text")

QUERIES = f"""
q AS (SELECT item_id::varchar AS query_id, item_id AS seq, {strip("text")} AS query FROM benchmark)"""

HITS = f"""{embedded("qv", "q", "query_id", "query")},
scored AS (
  SELECT query_id, chunk_id, (sum(qv.w::double * cv.w::double))::float::double AS score
  FROM qv JOIN cv USING (b) GROUP BY ALL
),
hits AS (
  SELECT * FROM (
    SELECT s.query_id, s.chunk_id, s.score, c.doc_id, c.source, c.text,
           row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, c.doc_id, c.chunk_index) AS rank
    FROM scored s JOIN chunks c USING (chunk_id)
  ) WHERE rank <= 50
)"""

FEATURES = f"""
chunk_tokens AS (SELECT chunk_id, unnest({tokens("text")}) AS token FROM chunks),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM chunk_tokens GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
dl AS (SELECT chunk_id, sum(tf)::bigint AS dl FROM tf GROUP BY ALL),
size AS (SELECT (SELECT count(*) FROM chunks)::double AS n, (SELECT sum(dl) FROM dl)::double AS nt),
qt AS (SELECT DISTINCT query_id, unnest({tokens("query")}) AS token FROM q),
qn AS (SELECT query_id, count(*) AS nq FROM qt GROUP BY ALL),
pairs AS (
  SELECT h.query_id, h.chunk_id, count(*) AS shared,
         sum(ln(1::double + (size.n - df.df + 0.5::double) / (df.df + 0.5::double)) * tf.tf * 2.2::double
             / (tf.tf + 1.2::double * (0.25::double + 0.75::double * dl.dl / (size.nt / size.n)))) AS bm25
  FROM hits h JOIN qt USING (query_id) JOIN tf ON tf.chunk_id = h.chunk_id AND tf.token = qt.token
  JOIN df ON df.token = qt.token JOIN dl ON dl.chunk_id = h.chunk_id CROSS JOIN size
  GROUP BY ALL
),
raw AS (
  SELECT h.*, q.query, coalesce(p.bm25, 0) AS bm25,
         coalesce(coalesce(p.shared, 0)::double / nullif(qn.nq, 0), 0) AS lexical_overlap,
         max(coalesce(p.bm25, 0)) OVER (PARTITION BY h.query_id) AS best
  FROM hits h JOIN q USING (query_id) LEFT JOIN pairs p USING (query_id, chunk_id)
  LEFT JOIN qn USING (query_id)
),
features AS (
  SELECT query_id, query, chunk_id, doc_id, source, text, rank, score AS dense_cosine,
         CASE WHEN best > 0 THEN bm25 / best ELSE 0 END AS cross_encoder_score, lexical_overlap
  FROM raw
),
linear AS (
  SELECT *, (0.5::double * dense_cosine + 0.3::double * cross_encoder_score
             + 0.2::double * lexical_overlap)::float::double AS rerank_score FROM features
),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank
  FROM linear
)"""

RELEVANCE = f"""
relevance AS (
  SELECT DISTINCT q.query_id, d.doc_id
  FROM (SELECT query_id, ' ' || array_to_string({words("query")}, ' ') || ' ' AS p FROM q) q
  JOIN (SELECT doc_id, ' ' || array_to_string({words("text")}, ' ') || ' ' AS t FROM docs) d
    ON contains(d.t, q.p) AND q.p <> '  '
)"""

LABELLED = """
labelled AS (
  SELECT r.*, (v.doc_id IS NOT NULL)::int::double AS label
  FROM reranked r LEFT JOIN relevance v USING (query_id, doc_id)
),
ideal AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, rank) AS ideal_rank FROM labelled
)"""


def gain(rank: str, k: int | None = None) -> str:
    cut = f" FILTER (WHERE {rank} <= {k})" if k else ""
    return f"sum(label / log2({rank} + 1)){cut}"


def ndcg(rank: str, k: int = 5) -> str:
    return f"coalesce(coalesce({gain(rank, k)}, 0) / nullif({gain('ideal_rank', k)}, 0), 0)"


def mrr(rank: str) -> str:
    return f"coalesce(1.0::double / min({rank}) FILTER (WHERE label > 0), 0)"


def found(rank: str, k: int = 5) -> str:
    return f"count(DISTINCT doc_id) FILTER (WHERE {rank} <= {k} AND label > 0)"


PER_QUERY = f"""
n_relevant AS (SELECT query_id, count(*) AS n FROM relevance GROUP BY ALL),
per_query AS (
  SELECT *, reranked_ndcg - dense_ndcg AS delta FROM (
    SELECT i.query_id, any_value(i.query) AS query, any_value(query_id::bigint) AS seq,
           {ndcg("rank")} AS dense_ndcg, {ndcg("rerank_rank")} AS reranked_ndcg,
           {mrr("rank")} AS dense_mrr, {mrr("rerank_rank")} AS reranked_mrr,
           coalesce({found("rank")} / nullif(any_value(n), 0), 0)::double AS dense_recall,
           coalesce({found("rerank_rank")} / nullif(any_value(n), 0), 0)::double AS reranked_recall
    FROM ideal i LEFT JOIN n_relevant USING (query_id) GROUP BY i.query_id
  )
)"""

PASSAGES = """
passages AS (
  SELECT query_id, any_value(query) AS query,
         string_agg('[' || chunk_id || '] ' || text, E'\\n\\n' ORDER BY rerank_rank) AS sources,
         string_agg(text || ' [' || chunk_id || ']', E'\\n' ORDER BY rerank_rank) AS answer,
         string_agg(chunk_id || '|' || source, ',' ORDER BY rerank_rank) AS source_list,
         string_agg(chunk_id, ',' ORDER BY rerank_rank) AS id_list,
         list(chunk_id) AS ids
  FROM reranked WHERE rerank_rank <= 5 GROUP BY query_id
)"""

ROUTER = f"""
labelled_docs AS (SELECT doc_id::varchar AS query_id, lang, text FROM documents),
{embedded("lv", "labelled_docs", "query_id", "text")},
class_size AS (SELECT lang, count(*) AS n FROM labelled_docs GROUP BY ALL),
centroids AS (
  SELECT d.lang, v.b, sum(v.w::double) / any_value(s.n) AS mean
  FROM lv v JOIN labelled_docs d USING (query_id) JOIN class_size s USING (lang) GROUP BY d.lang, v.b
)"""


def routed(source: str, vectors: str) -> str:
    """``routed``: query_id, intent, confidence of the rows of ``source``."""
    return f"""
similarity AS (
  SELECT query_id, lang, sum(w::double * mean) AS s FROM {vectors} JOIN centroids USING (b) GROUP BY ALL
),
shares AS (
  SELECT query_id, lang, (s / sum(s) OVER (PARTITION BY query_id))::float::double AS share FROM similarity
),
all_shares AS (
  SELECT r.query_id, c.lang, coalesce(x.share, 0) AS share
  FROM {source} r CROSS JOIN class_size c LEFT JOIN shares x ON x.query_id = r.query_id AND x.lang = c.lang
),
routed AS (
  SELECT query_id, lang AS intent, share AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, lang) AS pick FROM all_shares
  ) WHERE pick = 1
)"""


ASKED = f"""
asked AS (
  SELECT conv_id || '-' || turn AS query_id, {strip("text")} AS query
  FROM conversations WHERE role = 'user'
)"""


def cited(answer: str) -> str:
    return f"""list_filter(flatten(list_transform(
    regexp_extract_all({answer}, '\\[([^\\[\\]]+)\\]', 1),
    lambda body: regexp_split_to_array(body, '{SEPARATOR}'))),
    lambda t: contains(t, '#') AND NOT starts_with(t, '#') AND NOT ends_with(t, '#'))"""


GROUNDING = f"""
quoted AS (
  SELECT query_id, string_agg(text || ' [' || chunk_id || ']', E'\\n' ORDER BY rank) AS answer
  FROM reranked WHERE rank <= 5 GROUP BY query_id
),
citations AS (SELECT query_id, {cited("answer")} AS c FROM quoted),
scores AS (
  SELECT query_id, len(c) > 0 AS has_citation,
         CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda x: list_contains(ids, x)))::double / len(c)
              ELSE 1.0::double END AS valid_fraction,
         len(c) AS n_citations
  FROM citations JOIN passages USING (query_id)
)"""

HOLDOUT = """
class_n AS (SELECT lang, count(*) AS n FROM documents GROUP BY ALL),
test_total AS (SELECT ceil(sum(n) * 0.3::double)::bigint AS t, sum(n)::bigint AS n_all FROM class_n),
exact AS (SELECT lang, n, t, t * n / n_all::double AS x FROM class_n CROSS JOIN test_total),
quota AS (
  SELECT lang, floor(x)::bigint + (row_number() OVER (ORDER BY x - floor(x) DESC, lang)
         <= t - sum(floor(x)) OVER ())::int AS quota FROM exact
),
holdout AS (
  SELECT doc_id, lang, text, position <= quota AS is_test FROM (
    SELECT doc_id, lang, text,
           row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::varchar), doc_id) AS position
    FROM documents
  ) JOIN quota USING (lang)
)"""


def sql(*parts: str, select: str) -> str:
    return f"WITH {','.join(parts)}\n{select}" if parts else select


def r6(expression: str, name: str | None = None) -> str:
    return f"round(({expression})::double, 6) AS {name or expression}"


SEARCH = (CHUNKS, CHUNK_VECTORS, QUERIES, HITS)
RANKED = (*SEARCH, FEATURES)
EVALUATED = (*RANKED, RELEVANCE, LABELLED, PER_QUERY)
DOC_ROUTES = (ROUTER, routed("labelled_docs", "lv"))
PREDICTED = (
    *DOC_ROUTES,
    """
predicted AS (
  SELECT d.lang AS label, r.intent AS prediction FROM routed r JOIN labelled_docs d USING (query_id)
),
per_class AS (
  SELECT class, count(*) FILTER (WHERE truth) AS support,
         count(*) FILTER (WHERE truth AND hit) AS hits,
         2.0::double * count(*) FILTER (WHERE truth AND hit) / count(*) AS f1
  FROM (
    SELECT label AS class, true AS truth, label = prediction AS hit FROM predicted
    UNION ALL SELECT prediction, false, label = prediction FROM predicted
  ) GROUP BY class
)""",
)
ASK = (
    CHUNKS,
    CHUNK_VECTORS,
    ROUTER,
    ASKED,
    embedded("av", "asked", "query_id", "query"),
    routed("asked", "av"),
    f"""
q AS (SELECT a.query_id, a.query FROM asked a JOIN routed r USING (query_id) WHERE r.intent <> '{REFUSED_LANGUAGE}')""",
    HITS,
    FEATURES,
    PASSAGES,
)
ASK_SELECT = f"""
SELECT r.query_id, r.intent, {r6("r.confidence", "confidence")},
       md5(CASE WHEN r.intent = '{REFUSED_LANGUAGE}' THEN '{REFUSAL}' ELSE coalesce(p.answer, '') END) AS answer_md5,
       coalesce(p.id_list, '') AS sources
FROM routed r LEFT JOIN passages p USING (query_id)"""

ROLLUP = """
SELECT strftime(day, '%Y-%m-%d') AS day, intent, n, round(refusal_rate, 6) AS refusal_rate,
       round(p50, 6) AS p50, round(p95, 6) AS p95, round(mean, 9) AS mean
FROM (
  SELECT date_trunc('day', ts) AS day, event_type AS intent, count(*) AS n,
         avg((event_type = 'error')::int::double) AS refusal_rate,
         quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS mean
  FROM events GROUP BY ALL
)"""

ORACLES: dict[str, str] = {
    "chunk_documents": sql(CHUNKS, select="SELECT chunk_id, doc_id, source, chunk_index, text FROM chunks"),
    "chunk_ids": sql(CHUNKS, select="SELECT chunk_id FROM chunks"),
    "chunk_id_unique": sql(
        CHUNKS,
        select=f"""
SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_ids,
       count(DISTINCT chunk_id) FILTER (WHERE {cited("'[' || chunk_id || ']'")} <> [chunk_id]) AS n_broken_ids
FROM chunks""",
    ),
    "replicate_chunks": sql(
        CHUNKS,
        """
based AS (SELECT *, row_number() OVER (ORDER BY md5(chunk_id), chunk_id) - 1 AS p, count(*) OVER () AS n FROM chunks),
numbers AS (SELECT unnest(range(0, (SELECT 2 * count(*) + count(*) // 2 FROM chunks))) AS i)""",
        select="""
SELECT 'bench-' || i AS chunk_id, doc_id, chunk_index, i AS copy FROM numbers JOIN based ON i % n = p""",
    ),
    "token_sets": sql(
        CHUNKS,
        select=f"""
SELECT chunk_id, len(t)::bigint AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT chunk_id, list_sort(list_distinct({tokens("text")})) AS t FROM chunks)""",
    ),
    "corpus_frequencies": sql(
        CHUNKS,
        select=f"""
SELECT token, count(*) AS df
FROM (SELECT DISTINCT chunk_id, unnest({tokens("text")}) AS token FROM chunks) GROUP BY token""",
    ),
    "corpus_size": sql(
        CHUNKS,
        select=f"SELECT count(*) AS n_chunks, sum(len({tokens('text')}))::bigint AS n_tokens FROM chunks",
    ),
    "hash_embed": sql(CHUNKS, CHUNK_VECTORS, select=f"SELECT chunk_id, b AS bucket, {r6('w', 'weight')} FROM cv"),
    "hash_embed_idf": sql(
        CHUNKS,
        CHUNK_VECTORS,
        """
n AS (SELECT count(*) AS n FROM chunks),
rarity AS (SELECT b, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 AS idf FROM cv_counts, n GROUP BY b),
rare AS (SELECT chunk_id, b, c * idf AS x FROM cv_counts JOIN rarity USING (b)),
rare_unit AS (SELECT chunk_id, b, (x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)))::float AS w FROM rare)""",
        select=f"SELECT chunk_id, b AS bucket, {r6('w', 'weight')} FROM rare_unit",
    ),
    "l2_normalize": """
WITH v AS (
  SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::double * (label + 1) AS x
  FROM embeddings
)
SELECT vec_id, pos::bigint AS pos, round(norm, 6) AS norm, round(x / norm, 6) AS x
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM v)""",
    "index_build": sql(
        CHUNKS,
        CHUNK_VECTORS,
        select=f"""
SELECT c.chunk_id, c.doc_id, c.chunk_index, 256::bigint AS dim, {r6("coalesce(m.peak, 0)", "peak")}
FROM chunks c LEFT JOIN (SELECT chunk_id, max(w) AS peak FROM cv GROUP BY ALL) m USING (chunk_id)""",
    ),
    "index_stats": sql(
        CHUNKS,
        select="""
SELECT count(*) AS n_chunks, count(*) AS n_vectors, 256::bigint AS min_dim, 256::bigint AS max_dim FROM chunks""",
    ),
    "dense_topk": sql(*SEARCH, select=f"SELECT query_id, rank, chunk_id, {r6('score')} FROM hits"),
    "dense_topk_vectors": f"""
WITH entries AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings
),
means AS (
  SELECT label, i, sum(x) / count(*) AS mean FROM entries GROUP BY ALL
),
pairs AS (
  SELECT m.label::varchar AS query_id, e.vec_id::varchar AS chunk_id,
         sum(e.x * m.mean::float::double)::float::double AS score
  FROM entries e JOIN means m USING (i) GROUP BY ALL
)
SELECT query_id, rank, chunk_id, {r6("score")} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs
) WHERE rank <= {KNN}""",
    "dense_topk_k_gt_n": sql(
        ROUTER,
        f"""
pairs AS (
  SELECT d.query_id, c.lang AS chunk_id, coalesce(sum(v.w::double * m.mean::float::double), 0)::float::double AS score
  FROM labelled_docs d CROSS JOIN class_size c LEFT JOIN lv v ON v.query_id = d.query_id
  LEFT JOIN centroids m ON m.lang = c.lang AND m.b = v.b GROUP BY ALL
)""",
        select=f"""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank,
       chunk_id, {r6("score")} FROM pairs""",
    ),
    "lexical_overlap": sql(*RANKED, select=f"SELECT query_id, chunk_id, {r6('lexical_overlap')} FROM features"),
    "rank_features": sql(
        *RANKED,
        select=f"""
SELECT query_id, chunk_id, {r6("dense_cosine")}, {r6("cross_encoder_score")}, {r6("lexical_overlap")} FROM features""",
    ),
    "relevant_documents": sql(DOCS, QUERIES, RELEVANCE, select="SELECT query_id, doc_id FROM relevance"),
    "label_candidates": sql(*EVALUATED, select="SELECT query_id, rank, chunk_id, label FROM labelled"),
    "ranking_examples": sql(
        *EVALUATED,
        select=f"""
SELECT query_id, query_id::bigint AS seq, rank, {r6("dense_cosine")}, {r6("cross_encoder_score")},
       {r6("lexical_overlap")}, label FROM labelled""",
    ),
    "group_sizes": sql(*SEARCH, select="SELECT query_id, count(*) AS n_candidates FROM hits GROUP BY ALL"),
    "rerank_linear": sql(
        *RANKED,
        select=f"""
SELECT query_id, rerank_rank, chunk_id, {r6("rerank_score")} FROM reranked WHERE rerank_rank <= 5""",
    ),
    "rerank_ties": sql(
        *RANKED,
        select="""
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rerank_rank, chunk_id,
       round(s, 6) AS rerank_score
FROM (SELECT *, floor(lexical_overlap * 10) / 10 AS s FROM features)""",
    ),
    "dcg": sql(*EVALUATED, select=f"SELECT query_id, {r6(gain('rank'), 'dcg')} FROM ideal GROUP BY query_id"),
    "ndcg_at_5": sql(*EVALUATED, select=f"SELECT query_id, {r6(ndcg('rank'), 'ndcg')} FROM ideal GROUP BY query_id"),
    "mrr": sql(*EVALUATED, select=f"SELECT query_id, {r6(mrr('rank'), 'mrr')} FROM ideal GROUP BY query_id"),
    "recall_at_5": sql(*EVALUATED, select=f"SELECT query_id, {r6('dense_recall', 'recall')} FROM per_query"),
    "mean_ndcg": sql(*EVALUATED, select=f"SELECT {r6('avg(reranked_ndcg)', 'mean_ndcg')} FROM per_query"),
    "eval_rerank": sql(
        *EVALUATED,
        select=f"""
SELECT {r6("avg(dense_ndcg)", "dense_ndcg")}, {r6("avg(reranked_ndcg)", "reranked_ndcg")},
       {r6("avg(dense_mrr)", "dense_mrr")}, {r6("avg(reranked_mrr)", "reranked_mrr")},
       {r6("avg(dense_recall)", "dense_recall")}, {r6("avg(reranked_recall)", "reranked_recall")},
       count(*) FILTER (WHERE delta > 1e-9) AS n_improved, count(*) FILTER (WHERE delta < -1e-9) AS n_regressed,
       count(*) FILTER (WHERE abs(delta) <= 1e-9) AS n_tied, count(*) AS n_queries FROM per_query""",
    ),
    "rerank_uplift": sql(
        *EVALUATED,
        select=f"SELECT query_id, {r6('dense_ndcg')}, {r6('reranked_ndcg')}, {r6('delta')} FROM per_query",
    ),
    "uplift_summary": sql(
        *EVALUATED,
        select="""
SELECT count(*) FILTER (WHERE delta > 1e-9) AS n_improved, count(*) FILTER (WHERE delta < -1e-9) AS n_regressed,
       count(*) FILTER (WHERE abs(delta) <= 1e-9) AS n_tied FROM per_query""",
    ),
    "uplift_extremes": sql(
        *EVALUATED,
        select=f"""
SELECT CASE WHEN w.delta < 0 THEN w.query END AS worst_query, {r6("CASE WHEN w.delta < 0 THEN w.delta END", "worst_delta")},
       CASE WHEN b.delta > 0 THEN b.query END AS best_query, {r6("CASE WHEN b.delta > 0 THEN b.delta END", "best_delta")}
FROM (SELECT * FROM per_query ORDER BY delta, seq LIMIT 1) w
CROSS JOIN (SELECT * FROM per_query ORDER BY delta DESC, seq DESC LIMIT 1) b""",
    ),
    "best_trial": sql(
        *EVALUATED,
        "\nweights AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{n}', {d}::double, {p}::double, {o}::double)" for n, (d, p, o) in TRIAL_WEIGHTS.items())
        + ") AS t(trial, d, p, o))",
        f"""
trial_ranks AS (
  SELECT trial, i.query_id, label, ideal_rank, row_number() OVER (
    PARTITION BY trial, i.query_id
    ORDER BY (d * dense_cosine + p * cross_encoder_score + o * lexical_overlap)::float DESC, rank) AS new_rank
  FROM ideal i CROSS JOIN weights
),
trial_queries AS (SELECT trial, query_id, {ndcg("new_rank")} AS ndcg FROM trial_ranks GROUP BY ALL),
trials AS (SELECT trial, round(avg(ndcg), 6) AS metric FROM trial_queries GROUP BY trial)""",
        select="SELECT trial, metric FROM trials ORDER BY metric DESC, trial LIMIT 1",
    ),
    "route_centroid": sql(*DOC_ROUTES, select=f"SELECT query_id, intent, {r6('confidence')} FROM routed"),
    "confusion": sql(*PREDICTED, select="SELECT label, prediction, count(*) AS n FROM predicted GROUP BY ALL"),
    "f1_per_class": sql(*PREDICTED, select=f"SELECT class, support, hits, {r6('f1')} FROM per_class"),
    "f1_report": sql(
        *PREDICTED,
        select=f"""
SELECT {r6("avg(f1)", "macro_f1")}, {r6("sum(hits) / sum(support)", "accuracy")}, sum(support)::bigint AS n_test
FROM per_class""",
    ),
    "guardrail_split": sql(
        ROUTER,
        ASKED,
        embedded("av", "asked", "query_id", "query"),
        routed("asked", "av"),
        select=f"SELECT query_id, intent, intent = '{REFUSED_LANGUAGE}' AS refused FROM routed",
    ),
    "val_split": sql(
        QUERIES,
        select="""
SELECT query_id, position, position <= greatest(1, floor(n * 0.3::double)) AS is_validation
FROM (SELECT query_id, row_number() OVER (ORDER BY seq) AS position, count(*) OVER () AS n FROM q)""",
    ),
    "strat_split": sql(HOLDOUT, select="SELECT doc_id, lang, is_test FROM holdout"),
    "fold_assign": f"""
WITH n AS (SELECT greatest(2, least({FOLDS}, min(c))) AS k FROM (SELECT count(*) AS c FROM documents GROUP BY lang))
SELECT doc_id, lang,
       ((row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::varchar), doc_id) - 1) % k)::bigint AS fold
FROM documents CROSS JOIN n""",
    "fold_plan": f"""
SELECT min(c) AS smallest_class, greatest(2, least({FOLDS}, min(c)))::bigint AS n_folds
FROM (SELECT count(*) AS c FROM documents GROUP BY lang)""",
    "label_codes": """
SELECT label, n, (dense_rank() OVER (ORDER BY label) - 1)::bigint AS code
FROM (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang)""",
    "split_leakage": sql(
        HOLDOUT,
        select="""
SELECT sha256(text) AS text_digest FROM holdout WHERE is_test
INTERSECT SELECT sha256(text) FROM holdout WHERE NOT is_test""",
    ),
    "vocab_drift": f"""
WITH declared AS (SELECT unnest({DECLARED_ROLES}) AS label)
SELECT DISTINCT role AS label, 'undeclared' AS drift FROM conversations WHERE role NOT IN (SELECT label FROM declared)
UNION ALL SELECT label, 'unused' FROM declared WHERE label NOT IN (SELECT role FROM conversations)""",
    "dangling_labels": sql(
        DOCS,
        QUERIES,
        RELEVANCE,
        "\nreferenced AS (SELECT doc_id::varchar AS doc_id FROM labels UNION SELECT doc_id FROM relevance)",
        select="""
SELECT doc_id, 'missing' AS kind FROM referenced WHERE doc_id NOT IN (SELECT doc_id FROM docs)
UNION ALL SELECT doc_id, 'unlabelled' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM referenced)""",
    ),
    "format_passages": sql(*RANKED, PASSAGES, select="SELECT query_id, sources FROM passages"),
    "build_prompt": sql(
        *RANKED,
        PASSAGES,
        select=f"""
SELECT query_id, '{INSTRUCTION.replace("'", "''")}' AS system, 'ephemeral' AS cache, 'user' AS role,
       E'Sources:\\n' || sources || E'\\n\\nQuestion: ' || query AS content FROM passages""",
    ),
    "answer_sources": sql(*RANKED, PASSAGES, select="SELECT query_id, source_list AS sources FROM passages"),
    "extractive_answer": sql(*RANKED, PASSAGES, select="SELECT query_id, answer FROM passages"),
    "join_text_blocks": r"""
SELECT conv_id, turn, array_to_string(
  list_filter(string_split(text, E'\n'), lambda line: NOT regexp_matches(line, '[0-9]')), '') AS answer
FROM conversations""",
    "extract_citations": sql(
        CHUNKS,
        f"""
answers AS (
  SELECT chunk_id, text || ' [' || chunk_id || '; ' || doc_id || '] [' || chunk_id || ',' || split_part(chunk_id, '-', 1) || ']' AS answer
  FROM chunks
),
found AS (SELECT chunk_id, {cited("answer")} AS c FROM answers)""",
        select="""
SELECT chunk_id, (generate_subscripts(c, 1) - 1)::bigint AS position, unnest(c) AS citation FROM found""",
    ),
    "grounding_score": sql(
        *RANKED,
        PASSAGES,
        GROUNDING,
        select=f"SELECT query_id, has_citation, {r6('valid_fraction')}, n_citations FROM scores",
    ),
    "grounding_summary": sql(
        *RANKED,
        PASSAGES,
        GROUNDING,
        select=f"""
SELECT {r6("avg(valid_fraction)", "mean_valid_citation_fraction")},
       {r6("avg(has_citation::int)", "answers_with_citation")}, count(*) AS n_queries FROM scores""",
    ),
    "event_lines": """
SELECT event_id, json_object(
  'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00',
  'level', CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END,
  'component', 'serve', 'event', event_type, 'user_id', user_id, 'value', value,
  'k', (props->>'k')::bigint)::varchar AS line
FROM events""",
    "latency_summary": f"""
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 9) AS mean
FROM events GROUP BY event_type""",
    "latency_with_nulls": """
SELECT kind, count(v) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95,
       round(avg(v), 9) AS mean
FROM (SELECT CASE WHEN user_id % 7 <> 0 THEN event_type END AS kind,
             CASE WHEN user_id % 5 <> 0 THEN value END AS v FROM events)
GROUP BY kind""",
    "event_lines_blank": """
SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN json_object(
    'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', 'level', 'INFO', 'component', 'serve',
    'event', event_type, 'user_id', user_id)
  ELSE json_object(
    'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', 'level', 'INFO', 'component', 'serve',
    'event', event_type, 'user_id', user_id, 'k', (props->>'k')::bigint) END::varchar AS line
FROM events""",
    "event_rollup": ROLLUP,
    "ask_batch": sql(*ASK, select=ASK_SELECT),
    "stream_index_table": sql(
        CHUNKS, select="SELECT chunk_id, doc_id, chunk_index, 256::bigint AS dim FROM chunks"
    ),
    "stream_ask_answers": sql(*ASK, select=ASK_SELECT),
    "stream_event_rollup": ROLLUP,
    "stream_event_rollup_closed": ROLLUP.replace(
        "FROM events GROUP BY ALL",
        """FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
  GROUP BY ALL""",
    ),
}
ORACLES["dense_topk_scan"] = ORACLES["dense_topk"]

ORACLES["listwise_pulls"] = sql(
    *EVALUATED,
    """
placed AS (
  SELECT query_id, rank, label, dense_cosine AS score, power(2, label) - 1 AS gain,
         1 / log2(row_number() OVER (PARTITION BY query_id ORDER BY dense_cosine DESC, rank) + 1) AS at,
         row_number() OVER (PARTITION BY query_id ORDER BY label DESC) AS best
  FROM labelled
),
best_dcg AS (SELECT query_id, sum(gain / log2(best + 1)) AS ideal FROM placed GROUP BY ALL HAVING sum(gain) > 0),
rivals AS (
  SELECT a.query_id, a.rank, a.label > b.label AS up,
         1 / (1 + exp(CASE WHEN a.label > b.label THEN a.score - b.score ELSE b.score - a.score END)) AS wrong,
         abs(a.gain - b.gain) * abs(a.at - b.at) / ideal AS swap
  FROM placed a JOIN placed b ON a.query_id = b.query_id AND a.label <> b.label JOIN best_dcg i ON i.query_id = a.query_id
),
pulled AS (
  SELECT query_id, rank, sum(CASE WHEN up THEN wrong ELSE -wrong END * swap) AS g, sum(wrong * (1 - wrong) * swap) AS h
  FROM rivals GROUP BY ALL
)""",
    select=f"""
SELECT query_id, rank, {r6("coalesce(g, 0)", "pull")}, {r6("coalesce(h, 0)", "curvature")}
FROM placed SEMI JOIN best_dcg USING (query_id) LEFT JOIN pulled USING (query_id, rank)""",
)
