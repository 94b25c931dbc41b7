"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, metrics
from ..operators.retrieval import dense_top_k, hybrid
from . import inputs as I  # noqa: E741

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import catalogue_extra, catalogue_more  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue_extra, catalogue_more  # noqa: F401

    return dict(_SQL)


# -- pieces of SQL --------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def tok(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(lower({x}), '\bcarbon\s+dioxide\b', 'carbon_dioxide', 'g'), '\bco\s*2\b', 'carbon_dioxide', 'g')"
    return rf"list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]+') AND length(w) > 1 AND NOT list_contains([{_STOP}], w))"


def alnum(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


TOKENS = f"""d AS (SELECT doc_id, {tok('text')} AS toks FROM documents),
q AS (SELECT item_id AS query_id, text, {tok('text')} AS toks FROM benchmark)"""

BM = f"""{TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY ALL),
dl AS (SELECT doc_id, CAST(len(toks) AS DOUBLE) AS dl FROM d),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM q),
bm AS (SELECT query_id, doc_id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50),
ov AS (SELECT query_id, doc_id, count(*) / CAST(any_value(m) AS DOUBLE) AS score FROM (SELECT DISTINCT doc_id, term FROM tf) JOIN qt USING (term)
  JOIN (SELECT query_id, count(*) AS m FROM qt GROUP BY ALL) USING (query_id) GROUP BY ALL),
ovr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ov QUALIFY rank <= 50),
rr AS (SELECT query_id, doc_id, sum(1e0 / (60 + rank)) AS score FROM (SELECT query_id, doc_id, rank FROM br UNION ALL SELECT query_id, doc_id, rank FROM ovr) GROUP BY ALL),
rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rr QUALIFY rank <= 50),
gold AS (SELECT DISTINCT b.item_id AS query_id, doc_id FROM documents JOIN benchmark b ON contains(documents.text, b.text))"""


def metrics_sql(ranked: str, final: str) -> str:
    """Retrieval metrics of a CTE ``ranked`` (query_id, doc_id, rank)."""
    return f"""m1 AS (SELECT r.query_id, count(*) AS n_pred, count(DISTINCT g.doc_id) AS nh,
  count(DISTINCT CASE WHEN rank <= 5 THEN g.doc_id END) AS h5, count(DISTINCT CASE WHEN rank <= 10 THEN g.doc_id END) AS h10,
  count(DISTINCT CASE WHEN rank <= 50 THEN g.doc_id END) AS h50, min(CASE WHEN rank <= 10 AND g.doc_id IS NOT NULL THEN rank END) AS fst,
  sum(CASE WHEN rank <= 10 AND g.doc_id IS NOT NULL THEN 1e0 / log2(rank + 1) ELSE 0e0 END) AS dcg
  FROM {ranked} r LEFT JOIN gold g ON g.query_id = r.query_id AND g.doc_id = r.doc_id GROUP BY r.query_id),
m2 AS (SELECT query_id, count(*) AS ng FROM gold GROUP BY query_id),
m3 AS (SELECT q.query_id, coalesce(ng, 0) AS ng, m1.* EXCLUDE (query_id), CASE WHEN ng IS NULL THEN NULL ELSE
  list_sum(list_transform(range(1, CAST(least(ng, 10) AS BIGINT) + 1), lambda i: 1e0 / log2(i + 1))) END AS ideal FROM q LEFT JOIN m1 USING (query_id) LEFT JOIN m2 USING (query_id)),
m4 AS (SELECT query_id, ng, coalesce(h5 / CAST(nullif(ng, 0) AS DOUBLE), 0) AS recall_5, coalesce(h10 / CAST(nullif(ng, 0) AS DOUBLE), 0) AS recall_10,
  coalesce(h50 / CAST(nullif(ng, 0) AS DOUBLE), 0) AS recall_50, CASE WHEN h5 > 0 THEN 1e0 ELSE 0e0 END AS hit_5, CASE WHEN h10 > 0 THEN 1e0 ELSE 0e0 END AS hit_10,
  CASE WHEN h50 > 0 THEN 1e0 ELSE 0e0 END AS hit_50, coalesce(1e0 / fst, 0) AS mrr_10, coalesce(dcg / ideal, 0) AS ndcg_10,
  coalesce(nh / CAST(nullif(n_pred, 0) AS DOUBLE), 0) AS p, coalesce(nh / CAST(nullif(ng, 0) AS DOUBLE), 0) AS r FROM m3),
m5 AS (SELECT * EXCLUDE (p, r), p AS evidence_precision, r AS evidence_recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS evidence_f1 FROM m4)
{final}"""


_METRIC_NAMES = (
    "recall_5 recall_10 recall_50 hit_5 hit_10 hit_50 mrr_10 ndcg_10 evidence_precision evidence_recall evidence_f1"
).split()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- text -----------------------------------------------------------------------------------


@_query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize(spark, d):
    t = T.tokens(F.col("text"))
    return I.documents(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@_query(f"WITH x AS (SELECT unnest({tok('text')}) AS token FROM documents) SELECT token, count(*) AS n FROM x GROUP BY token")
def token_stats(spark, d):
    return I.documents(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@_query(
    rf"""SELECT doc_id, array_to_string({alnum('text')}, ' ') AS alnum, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS collapsed_md5,
    CAST(len(list_distinct({alnum('text')})) AS INTEGER) AS n_distinct FROM documents"""
)
def normalise_text(spark, d):
    t = F.col("text")
    return I.documents(spark, d).select(
        "doc_id", T.normalised(t).alias("alnum"), F.md5(T.collapsed(t)).alias("collapsed_md5"), F.size(F.array_distinct(T.alnum_tokens(t))).alias("n_distinct")
    )


@_query(
    f"""WITH x AS (SELECT doc_id, {tok('text')} AS t FROM documents) SELECT doc_id,
    array_to_string(list_sort(list_distinct(list_filter(t, lambda w: regexp_matches(w, '[0-9]')))), ' ') AS numbers,
    array_to_string(list_sort(list_distinct(list_filter(t, lambda w: regexp_full_match(w, '[0-9]{{4}}')))), ' ') AS years FROM x"""
)
def number_year_tokens(spark, d):
    t = T.tokens(F.col("text"))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return I.documents(spark, d).select("doc_id", text(T.number_tokens(t)).alias("numbers"), text(T.year_tokens(t)).alias("years"))


@_query()
def extract_constraints(spark, d):
    c = T.constraints(F.col("text"))
    return I.documents(spark, d).select("doc_id", c.alias("c")).select("doc_id", *[F.array_join(f"c.{x}", "|").alias(x) for x in ("years", "numbers", "entities")])


@_query(
    rf"""WITH x AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark),
    y AS (SELECT item_id, t, list_transform(regexp_split_to_array(t, '(?i)\b(?:and|while|whereas|because|but)\b|[;]'), lambda p: trim(p, ' ,;:-')) AS ps FROM x)
    SELECT item_id AS query_id, array_to_string(list_filter(ps, lambda p: p <> '' AND p <> t AND len({tok('p')}) >= 4)[1:2], '|') AS parts FROM y"""
)
def decompose_claim(spark, d):
    return I.claims(spark, d).select("query_id", F.array_join(T.decomposed(F.col("text")), "|").alias("parts"))


@_query(
    "SELECT doc_id, regexp_matches(text, '-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----') AS private_key, regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') AS access_key,"
    " regexp_matches(text, '(?i)\\b(?:api[_-]?key|access[_-]?token|secret)\\s*[:=]\\s*[''\"][^''\"]+') AS assigned_secret,"
    " regexp_matches(text, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]{20,}') AS bearer, regexp_matches(text, '(^|[^A-Za-z])[A-Za-z]:[\\\\/]|/data/gpfs/|/home/') AS local_path FROM documents"
)
def secret_scan(spark, d):
    return I.documents(spark, d).select("doc_id", *[F.col("text").rlike(p).alias(n) for n, p in T.SECRET_PATTERNS.items()])


_HASH = "('0x' || substr(sha256({}), 1, 16))::UBIGINT"


@_query(f"SELECT doc_id, CAST({_HASH.format('CAST(doc_id AS VARCHAR)')} % 5 AS INTEGER) AS fold FROM documents")
def stable_fold(spark, d):
    return I.documents(spark, d).select("doc_id", T.stable_fold(F.col("doc_id"), 5).alias("fold"))


@_query(f"SELECT doc_id, {_HASH.format(chr(39) + '45:' + chr(39) + ' || doc_id')} / 18446744073709551616e0 < 1e-1 AS in_eval FROM documents")
def hash_split(spark, d):
    return I.documents(spark, d).select("doc_id", T.in_hash_share(F.col("doc_id"), 0.1, 45).alias("in_eval"))


@_query("SELECT source, count(*) AS n, sha256(string_agg(sha256(CAST(doc_id AS VARCHAR)), '' ORDER BY doc_id)) AS ids_sha256 FROM documents GROUP BY source")
def sha256_ids(spark, d):
    rows = I.table(spark, d, "documents").select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    listed = F.array_sort(F.collect_list(F.struct("doc_id", "h")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sha2(F.array_join(listed["h"], ""), 256).alias("ids_sha256"))


# -- BM25 -----------------------------------------------------------------------------------


@_query(f"WITH {BM} SELECT term, CAST(df AS BIGINT) AS df, round(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)), 6) AS idf FROM df CROSS JOIN st")
def bm25_terms(spark, d):
    return I.index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@_query(f"WITH {BM} SELECT term, doc_id, tf, CAST(dl AS INTEGER) AS dl FROM tf JOIN dl USING (doc_id)")
def bm25_postings(spark, d):
    return I.index(spark, d).postings


@_query(f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br")
def bm25_topk(spark, d):
    return rounded(I.bm25(spark, d).select("query_id", "doc_id", "score", "rank"))


@_query(f"WITH {BM}, {metrics_sql('br', 'SELECT query_id, ' + ', '.join(f'round({m}, 6) AS {m}' for m in _METRIC_NAMES) + ' FROM m5')}")
def bm25_metrics(spark, d):
    return rounded(metrics.retrieval_metrics(I.claims(spark, d), I.bm25(spark, d), I.gold(spark, d)))


@_query(f"WITH {BM}, {metrics_sql('br', 'SELECT count(*) AS n_claims, ' + ', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRIC_NAMES) + ' FROM m5')}")
def ir_metrics_macro(spark, d):
    return rounded(metrics.macro(metrics.retrieval_metrics(I.claims(spark, d), I.bm25(spark, d), I.gold(spark, d))))


@_query(
    f"WITH {BM}, "
    + metrics_sql("br", "SELECT query_id, CASE WHEN ng > 0 AND evidence_recall = 0 THEN 'retrieval_miss' WHEN evidence_f1 < 1 THEN 'partial_or_over_retrieval' ELSE 'none' END AS category FROM m5")
)
def error_categories(spark, d):
    gold = I.gold(spark, d)
    return metrics.error_categories(metrics.retrieval_metrics(I.claims(spark, d), I.bm25(spark, d), gold), gold)


@_query("SELECT DISTINCT b.item_id AS query_id, doc_id FROM documents JOIN benchmark b ON contains(documents.text, b.text)")
def required_evidence(spark, d):
    return I.gold(spark, d)


# -- dense ----------------------------------------------------------------------------------


@_query(
    "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first"
    " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
)
def l2_normalize(spark, d):
    e = I.table(spark, d, "embeddings")
    n = T.l2_normalised(F.col("embedding"))
    return rounded(e.select("vec_id", T.dot(F.col("embedding"), F.col("embedding")).alias("norm2"), n[0].alias("first")))


_DENSE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_inner_product(a.v, b.v) AS score FROM n a JOIN n b ON a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""


@_query(f"{_DENSE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r")
def dense_flat_topk(spark, d):
    e = I.table(spark, d, "embeddings")
    return rounded(dense_top_k(e, e.where("vec_id % 20 = 0"), 10).select("query_id", "doc_id", "score", "rank"))


# -- fusion ---------------------------------------------------------------------------------


def _routes(spark, d):
    return {"bm25": I.bm25(spark, d), "overlap": I.overlap_route(spark, d)}


def _rankings(spark, d):
    a, b = (df.select("query_id", F.lit(n).alias("source"), "doc_id", "rank") for n, df in _routes(spark, d).items())
    return a.unionByName(b)


@_query(f"WITH {BM} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM rrf")
def rrf(spark, d):
    return rounded(fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50), 9)


@_query(
    f"""WITH {BM}, w AS (SELECT query_id, doc_id, coalesce(br.rank, 0) AS base_rank, coalesce(ovr.rank, 0) AS reranker_rank,
    coalesce(2e0 / (60 + br.rank), 0) + coalesce(1e0 / (60 + ovr.rank), 0) AS score FROM br FULL JOIN ovr USING (query_id, doc_id))
    SELECT query_id, doc_id, CAST(base_rank AS INTEGER) AS base_rank, CAST(reranker_rank AS INTEGER) AS reranker_rank, round(score, 9) AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 20"""
)
def weighted_rank_fuse(spark, d):
    r = _routes(spark, d)
    return rounded(fusion.weighted_rank_fusion(r["bm25"], r["overlap"], top=20, base_weight=2.0), 9)


@_query(f"WITH {BM} SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM rrf WHERE rank <= 5")
def hybrid_topk(spark, d):
    return rounded(hybrid(_routes(spark, d)), 9)


_FEATURES = f"""WITH {BM}, c AS (SELECT rrf.query_id, rrf.doc_id, rrf.score AS rs, rrf.rank AS rr_, br.score AS bs, br.rank AS brk, ovr.score AS os, ovr.rank AS ork,
  list_distinct(q.toks) AS qt_, list_distinct(d.toks) AS dt_ FROM rrf LEFT JOIN br USING (query_id, doc_id) LEFT JOIN ovr USING (query_id, doc_id) JOIN q ON q.query_id = rrf.query_id JOIN d ON d.doc_id = rrf.doc_id),
c2 AS (SELECT *, list_filter(qt_, lambda w: regexp_matches(w, '[0-9]')) AS qn, list_filter(qt_, lambda w: regexp_full_match(w, '[0-9]{{4}}')) AS qy FROM c),
f AS (SELECT query_id, doc_id, coalesce(bs, 0) AS bm25_score, coalesce(1e0 / brk, 0) AS bm25_reciprocal_rank, coalesce(os, 0) AS dense_score, coalesce(1e0 / ork, 0) AS dense_reciprocal_rank,
  rs AS rrf_score, 1e0 / rr_ AS rrf_reciprocal_rank,
  coalesce(len(list_intersect(qt_, dt_)) / CAST(nullif(len(qt_), 0) AS DOUBLE), 0) AS token_overlap, coalesce(len(list_intersect(qn, dt_)) / CAST(nullif(len(qn), 0) AS DOUBLE), 0) AS number_overlap,
  coalesce(len(list_intersect(qy, dt_)) / CAST(nullif(len(qy), 0) AS DOUBLE), 0) AS year_overlap, CAST(len(qt_) AS DOUBLE) AS query_length, CAST(len(dt_) AS DOUBLE) AS document_length FROM c2)"""


def _features(spark, d):
    r = _routes(spark, d)
    fused = fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50)
    return fusion.candidate_features(fusion.wide_candidates(r["bm25"], r["overlap"], fused), I.claims(spark, d), I.documents(spark, d))


@_query(f"{_FEATURES} SELECT query_id, doc_id, {', '.join(f'round({x}, 6) AS {x}' for x in fusion.FEATURES)} FROM f")
def candidate_features(spark, d):
    return rounded(_features(spark, d))


@_query(
    f"""WITH {BM} SELECT CASE WHEN br.doc_id IS NOT NULL AND ovr.doc_id IS NOT NULL THEN 'both' WHEN br.doc_id IS NOT NULL THEN 'bm25_only' ELSE 'dense_only' END AS source_class, count(*) AS n
    FROM rrf LEFT JOIN br USING (query_id, doc_id) LEFT JOIN ovr USING (query_id, doc_id) GROUP BY ALL"""
)
def candidate_source_mix(spark, d):
    r = _routes(spark, d)
    wide = fusion.wide_candidates(r["bm25"], r["overlap"], fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50))
    return wide.select(fusion.source_class(F.col("bm25_rank"), F.col("dense_rank")).alias("source_class")).groupBy("source_class").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {BM}, a AS (SELECT query_id, doc_id, 'bm25' AS source, rank FROM br UNION ALL SELECT query_id, doc_id, 'overlap', rank FROM ovr),
    n AS (SELECT query_id, doc_id, min(rank) AS best_rank, string_agg(source || ':' || rank, ',' ORDER BY source) AS sources FROM a ANTI JOIN gold USING (query_id, doc_id) GROUP BY ALL)
    SELECT query_id, doc_id, CAST(best_rank AS INTEGER) AS best_rank, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS INTEGER) AS rank FROM n QUALIFY rank <= 20"""
)
def hard_negatives(spark, d):
    out = fusion.hard_negatives(_rankings(spark, d), I.gold(spark, d))
    listed = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.select("query_id", "doc_id", "best_rank", F.array_join(F.array_sort(listed), ",").alias("sources"), "rank")


@_query(
    f"""{_FEATURES}, s AS (SELECT query_id, doc_id, 65e-2 * token_overlap + 20e-2 * number_overlap + 15e-2 * year_overlap AS score FROM f)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
)
def deterministic_rerank(spark, d):
    fused = fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50)
    return rounded(fusion.deterministic_rerank(fused, I.claims(spark, d), I.documents(spark, d), top=10))


_PROFILES = [("even", 60, 1.0, 1.0), ("base_heavy", 60, 4.0, 1.0), ("sharp", 0, 1.0, 2.0)]
_P_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS system, query_id, doc_id, coalesce({bw}e0 / ({k} + br.rank), 0) + coalesce({rw}e0 / ({k} + ovr.rank), 0) AS score FROM br FULL JOIN ovr USING (query_id, doc_id)"
    for n, k, bw, rw in _PROFILES
)


@_query(f"WITH {BM}, w AS ({_P_SQL}) SELECT system, query_id, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY system, query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 5")
def fusion_profiles(spark, d):
    r = _routes(spark, d)
    return rounded(fusion.fusion_profiles(r["bm25"], r["overlap"], _PROFILES, top=5).select("system", "query_id", "doc_id", "score", "rank"), 9)


# -- five stages ----------------------------------------------------------------------------

_SYSTEMS = f"""{_FEATURES}, rer AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(65e-2 * token_overlap + 20e-2 * number_overlap + 15e-2 * year_overlap, 9) DESC, doc_id) AS rank FROM f),
fz AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1e0 / (60 + rrf.rank), 0) + coalesce(1e0 / (60 + rer.rank), 0), 9) DESC, doc_id) AS rank FROM rrf FULL JOIN rer USING (query_id, doc_id)),
sys AS (SELECT 'bm25' AS system, query_id, doc_id, rank FROM br WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM ovr WHERE rank <= 5 UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM rrf WHERE rank <= 5
  UNION ALL SELECT 'reranked', query_id, doc_id, rank FROM rer WHERE rank <= 5 UNION ALL SELECT 'fused', query_id, doc_id, rank FROM fz WHERE rank <= 5),
hit AS (SELECT system, q.query_id, count(g.doc_id) AS h, min(CASE WHEN g.doc_id IS NOT NULL THEN rank END) AS fst FROM (SELECT DISTINCT system FROM sys) CROSS JOIN q LEFT JOIN sys USING (system, query_id)
  LEFT JOIN gold g ON g.query_id = q.query_id AND g.doc_id = sys.doc_id GROUP BY ALL)
SELECT system, count(*) AS n_claims, round(avg(coalesce(h / CAST(ng AS DOUBLE), 0)), 6) AS recall_5, round(avg(coalesce(1e0 / fst, 0)), 6) AS mrr_10 FROM hit LEFT JOIN (SELECT query_id, count(*) AS ng FROM gold GROUP BY ALL) USING (query_id) GROUP BY system"""


@_query(_SYSTEMS)
def five_stage_metrics(spark, d):
    """bm25, second route, their fusion, the reranked fusion, and the fusion of both; each cut to five, judged in one pass."""
    claims, docs, gold = I.claims(spark, d), I.documents(spark, d), I.gold(spark, d)
    routes = _routes(spark, d)
    fused = fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50)
    reranked = fusion.deterministic_rerank(fused, claims, docs, top=50)
    both = fusion.weighted_rank_fusion(fused, reranked, top=50)
    union = None
    for name, df in (("bm25", routes["bm25"]), ("dense", routes["overlap"]), ("rrf", fused), ("reranked", reranked), ("fused", both)):
        one = df.where("rank <= 5").select(F.lit(name).alias("system"), "query_id", "doc_id", "rank")
        union = one if union is None else union.unionByName(one)
    systems = F.explode(F.array(*[F.lit(n) for n in ("bm25", "dense", "rrf", "reranked", "fused")])).alias("system")
    key = lambda df: df.withColumn("query_id", F.struct("system", "query_id"))
    asked = key(claims.select("query_id", systems))
    per = metrics.retrieval_metrics(asked, key(union), key(gold.select("query_id", "doc_id", systems)), ks=(5,))
    return rounded(
        per.withColumn("system", F.col("query_id.system")).groupBy("system").agg(F.count("*").alias("n_claims"), F.avg("recall_5").alias("recall_5"), F.avg("mrr_10").alias("mrr_10"))
    )


