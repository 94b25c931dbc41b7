"""Further queries: whole evaluations, routing features, splits and audits, hashes, serving, the dense route."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..files import framed_column
from ..functions import text as T
from ..operators import evaluation, fusion, metrics, protocols, ranking, serving, splitting, training
from ..operators.retrieval import hybrid
from . import inputs as I  # noqa: E741
from .catalogue import _FEATURES, _METRIC_NAMES, BM, _features, _query, alnum, metrics_sql, rounded

# -- evaluation -----------------------------------------------------------------------------

_REPEATED = "rep AS (SELECT query_id, doc_id, 2 * rank - 1 AS rank FROM br WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2 * rank FROM br WHERE rank <= 10)"


def _repeated(spark, d):
    first = I.bm25(spark, d, 10).select("query_id", "doc_id", "rank")
    return first.select("query_id", "doc_id", (2 * F.col("rank") - 1).alias("rank")).unionByName(first.select("query_id", "doc_id", (2 * F.col("rank")).alias("rank")))


@_query(f"WITH {BM}, {_REPEATED}, {metrics_sql('rep', 'SELECT query_id, ' + ', '.join(f'round({m}, 6) AS {m}' for m in _METRIC_NAMES) + ' FROM m5')}")
def metrics_repeated_ids(spark, d):
    """Rankings that name every id twice: a repeated id counts in the length and in the gain, but once as found."""
    return rounded(metrics.retrieval_metrics(I.claims(spark, d), _repeated(spark, d), I.gold(spark, d)))


_LABELS = "CASE WHEN {0} % 3 = 0 THEN 'SUPPORTS' WHEN {0} % 3 = 1 THEN 'REFUTES' END"


def _claims_and_predictions(spark, d):
    kind = lambda c: F.when(c % 3 == 0, "SUPPORTS").when(c % 3 == 1, "REFUTES")
    claims = I.claims(spark, d).withColumn("label", kind(F.col("query_id")))
    ranked = I.bm25(spark, d, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id")))["doc_id"].alias("evidence_ids"))
    predicted = claims.select("query_id", kind(F.floor(F.col("query_id") / 2)).alias("label")).join(ranked, "query_id").where("query_id % 7 <> 0")
    return claims, predicted


_EVALUATED = f"""pq AS (SELECT query_id, {_LABELS.format('query_id')} AS gold_label, CASE WHEN query_id % 7 <> 0 AND query_id IN (SELECT query_id FROM br) THEN {_LABELS.format('(query_id // 2)')} END AS predicted FROM q),
pr AS (SELECT * FROM br WHERE rank <= 5 AND query_id % 7 <> 0),
"""
_EVAL_ROWS = """, ev AS (SELECT m5.*, gold_label, CASE WHEN gold_label IS NOT NULL THEN CASE WHEN coalesce(predicted = gold_label, FALSE) THEN 1e0 ELSE 0e0 END END AS label_correct,
  CASE WHEN ng > 0 AND evidence_recall = 0 THEN 'retrieval_miss' WHEN evidence_f1 < 1 THEN 'partial_or_over_retrieval' END AS c1 FROM m5 JOIN pq USING (query_id))"""


@_query(
    f"WITH {BM}, {_EVALUATED} "
    + metrics_sql("pr", _EVAL_ROWS + " SELECT query_id, round(evidence_f1, 6) AS evidence_f1, label_correct, concat_ws(',', c1, CASE WHEN label_correct = 0 THEN 'classification_error' END) AS categories FROM ev")
)
def evaluate_rows(spark, d):
    claims, predicted = _claims_and_predictions(spark, d)
    per = evaluation.evaluated(claims, predicted, I.gold(spark, d))
    return rounded(per.select("query_id", "evidence_f1", "label_correct", F.array_join("categories", ",").alias("categories")))


@_query(
    f"WITH {BM}, {_EVALUATED} "
    + metrics_sql("pr", _EVAL_ROWS + ", z AS (SELECT count(*) AS claim_count, count(label_correct) AS labelled, avg(label_correct) AS acc, avg(evidence_f1) AS f1, avg(recall_5) AS r5 FROM ev) SELECT claim_count, labelled AS labelled_claim_count, round(acc, 6) AS claim_accuracy, round(f1, 6) AS evidence_f1, round(r5, 6) AS recall_5, round(CASE WHEN f1 + acc > 0 THEN 2 * f1 * acc / (f1 + acc) ELSE 0 END, 6) AS harmonic_mean FROM z")
)
def evaluate_whole(spark, d):
    claims, predicted = _claims_and_predictions(spark, d)
    got = evaluation.aggregate(evaluation.evaluated(claims, predicted, I.gold(spark, d)))
    names = ["claim_count", "labelled_claim_count", "claim_accuracy", "evidence_f1", "recall_5", "harmonic_mean"]
    return rounded(spark.createDataFrame([tuple(got[n] for n in names)], "claim_count long, labelled_claim_count long, claim_accuracy double, evidence_f1 double, recall_5 double, harmonic_mean double"))


def _both_metrics(spark, d):
    claims, gold = I.claims(spark, d), I.gold(spark, d)
    return [metrics.retrieval_metrics(claims, route(spark, d), gold) for route in (I.overlap_route, I.bm25)]


@_query()
def metric_comparison(spark, d):
    """Four metrics of two routes in pairs, with the interval of 5,000 bootstrap means."""
    return rounded(evaluation.compared(*_both_metrics(spark, d)))


@_query(
    f"WITH {BM}, "
    + f"""x AS (SELECT query_id, min(CASE WHEN g.doc_id IS NOT NULL AND rank <= 10 THEN rank END) AS f FROM br LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1),
    y AS (SELECT query_id, min(CASE WHEN g.doc_id IS NOT NULL AND rank <= 10 THEN rank END) AS f FROM ovr LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1)
    SELECT q.query_id, 'mrr_10' AS metric, round(coalesce(1e0 / x.f, 0) - coalesce(1e0 / y.f, 0), 6) AS difference FROM q LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id)"""
)
def paired_differences(spark, d):
    return rounded(evaluation.paired(*_both_metrics(spark, d), metrics=("mrr_10",)))


@_query(
    """WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_brand AS g, CAST(p_size AS DOUBLE) AS s, p_retailprice AS p, CAST(length(p_name) AS DOUBLE) AS m FROM part WHERE p_partkey % 10 = 0),
    b AS (SELECT a.name, string_agg(b.name, ',' ORDER BY b.name) AS l FROM a JOIN a b ON a.g = b.g AND b.s >= a.s AND b.p <= a.p AND b.m <= a.m AND (b.s > a.s OR b.p < a.p OR b.m < a.m) GROUP BY 1)
    SELECT name, CASE WHEN l IS NULL THEN 'frontier' ELSE 'dominated' END AS pareto_status, coalesce(l, '') AS dominated_by FROM a LEFT JOIN b USING (name)"""
)
def pareto_dominators(spark, d):
    """Profiles (every tenth part) with the names of those that are as good in all and better in one number."""
    rows = I.table(spark, d, "part").where("p_partkey % 10 = 0").select(
        F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("comparability_group"), F.col("p_size").cast("double").alias("evidence_f1"),
        F.col("p_retailprice").alias("p95_ms"), F.length("p_name").cast("double").alias("memory_bytes"),
    )
    return evaluation.pareto(rows).select("name", "pareto_status", F.array_join("dominated_by", ",").alias("dominated_by"))


@_query(
    """WITH e AS (SELECT vec_id, CAST(embedding[1:3] AS DOUBLE[]) AS v, label % 3 AS y FROM embeddings), g AS (SELECT i, 5e-2 * pow(200e0, i / 400e0) AS t FROM range(401) r(i)),
    l AS (SELECT i, t, -ln(greatest(exp(10 * v[y + 1] / t - list_max(v) * 10 / t) / list_sum(list_transform(v, lambda x: exp(10 * x / t - list_max(v) * 10 / t))), 1e-15)) AS nll FROM e, g),
    m AS (SELECT i, t, round(avg(nll), 9) AS nll FROM l GROUP BY ALL) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM m ORDER BY m.nll, i LIMIT 1"""
)
def temperature_fit(spark, d):
    """The first of 401 temperatures from 0.05 to 10 in equal ratios with the least negative log likelihood."""
    rows = I.logits(spark, d)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(0.05 * 200 ** (i / 400)).alias("t")) for i in range(401)])).alias("g")
    each = rows.select("logits", "label", steps)
    top = F.array_max("logits")
    part = lambda x: F.exp((x - top) / F.col("g.t"))
    p = part(F.get("logits", F.col("label").cast("int"))) / F.aggregate("logits", F.lit(0.0), lambda a, x: a + part(x))
    per = each.groupBy("g").agg(F.round(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))), 9).alias("nll"))
    return rounded(per.agg(F.min(F.struct("nll", "g.i", "g.t")).alias("b")).select(F.col("b.t").alias("temperature"), F.col("b.nll").alias("nll")))


# -- routing --------------------------------------------------------------------------------


def _agree(a: str, b: str, tag: str) -> str:
    j = f"SELECT query_id, x.rank AS lr, y.rank AS rr FROM {a} x JOIN {b} y USING (query_id, doc_id)"
    ks = ", ".join(f"sum(CASE WHEN lr <= {k} AND rr <= {k} THEN 1 ELSE 0 END) / {k}e0 AS {tag}_overlap_at_{k}" for k in (1, 3, 5))
    return f"""{tag} AS (SELECT query_id, {', '.join(f'round(coalesce({tag}_overlap_at_{k}, 0), 6) AS {tag}_overlap_at_{k}' for k in (1, 3, 5))}, round(coalesce(g, 0) / greatest(coalesce(nl, 0), coalesce(nr, 0), 1), 6) AS {tag}_rank_agreement
    FROM (SELECT query_id, count(*) AS nl FROM {a} GROUP BY 1) FULL JOIN (SELECT query_id, count(*) AS nr FROM {b} GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, {ks}, sum(2e0 / (lr + rr)) AS g FROM ({j}) GROUP BY 1) USING (query_id))"""


@_query(
    f"""WITH {BM}, {_agree('br', 'ovr', 'bm25_dense')}, {_agree('br', 'rrf', 'bm25_rrf')}, {_agree('ovr', 'rrf', 'dense_rrf')},
    s AS (SELECT query_id, round(avg(CASE WHEN b.doc_id IS NOT NULL AND o.doc_id IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS rrf_supported_by_both,
    round(avg(CASE WHEN (b.doc_id IS NULL) <> (o.doc_id IS NULL) THEN 1e0 ELSE 0e0 END), 6) AS rrf_supported_by_exactly_one FROM rrf LEFT JOIN br b USING (query_id, doc_id) LEFT JOIN ovr o USING (query_id, doc_id) GROUP BY 1)
    SELECT * FROM bm25_dense JOIN bm25_rrf USING (query_id) JOIN dense_rrf USING (query_id) JOIN s USING (query_id)"""
)
def route_features(spark, d):
    """The fourteen agreement features of two routes and their fusion."""
    a, b = I.bm25(spark, d), I.overlap_route(spark, d)
    lists = a.select("query_id", F.lit("a").alias("source"), "doc_id", "rank").unionByName(b.select("query_id", F.lit("b").alias("source"), "doc_id", "rank"))
    return rounded(ranking.route_features(a, b, fusion.reciprocal_rank_fusion(lists, top=50)))


@_query(
    f"""WITH t AS (SELECT item_id AS query_id, text, {alnum('text')} AS w FROM benchmark) SELECT query_id, round(ln(1 + len(w)), 6) AS text_log_token_count,
    round(len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) / greatest(len(w), 1), 6) AS text_digit_token_fraction,
    round(len(list_filter(w, lambda x: list_contains([{', '.join(f"'{n}'" for n in ranking.ROUTE_NEGATIONS)}], x))) / greatest(len(w), 1), 6) AS text_negation_fraction,
    CAST(length(text) - length(replace(replace(text, '[', ''), ']', '')) AS DOUBLE) AS text_bracket_count, CAST(length(text) - length(replace(text, '?', '')) AS DOUBLE) AS text_question_mark_count FROM t"""
)
def text_route_scalars(spark, d):
    return rounded(ranking.text_route_features(I.claims(spark, d)).drop("hashed"))


@_query(
    f"""WITH {BM}, x AS (SELECT query_id, min(CASE WHEN g.doc_id IS NOT NULL AND rank <= 10 THEN rank END) AS f FROM br LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1),
    y AS (SELECT query_id, min(CASE WHEN g.doc_id IS NOT NULL AND rank <= 10 THEN rank END) AS f FROM ovr LEFT JOIN gold g USING (query_id, doc_id) GROUP BY 1),
    z AS (SELECT q.query_id, q.query_id % 2 = 0 AS s, coalesce(1e0 / x.f, 0) AS st, coalesce(1e0 / y.f, 0) AS wk FROM q LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id)),
    w AS (SELECT avg(wk) AS wk, avg(st) AS st, avg(CASE WHEN s THEN st ELSE wk END) AS ro, avg(CASE WHEN s THEN 1e0 ELSE 0e0 END) AS r FROM z)
    SELECT round(r, 6) AS strong_call_rate, round(ro, 6) AS routed_mrr_10, round((ro - wk) / nullif(st - wk, 0), 6) AS preserved_mrr_10, round(1e-1 + r * 5, 6) AS seconds_per_query FROM w"""
)
def router_evaluation(spark, d):
    weak, strong = _both_metrics(spark, d)
    rows = weak.select("query_id", F.col("mrr_10").alias("weak_mrr_10")).join(strong.select("query_id", F.col("mrr_10").alias("strong_mrr_10")), "query_id")
    got = ranking.routed_metrics(rows.withColumn("selected", F.col("query_id") % 2 == 0), ["mrr_10"], weak_seconds=0.1, strong_seconds=5.0)
    names = ["strong_call_rate", "routed_mrr_10", "preserved_mrr_10", "seconds_per_query"]
    return rounded(spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} double" for n in names)))


@_query("SELECT doc_id AS claim_id, CAST(max(CASE WHEN s = 0 THEN v END) AS BIGINT) AS weak, CAST(max(CASE WHEN s = 1 THEN v END) AS BIGINT) AS strong FROM (SELECT doc_id % 50 AS doc_id, doc_id % 2 AS s, max_by(n_chars, doc_id) AS v FROM documents GROUP BY ALL) GROUP BY 1")
def predictions_by_system(spark, d):
    """Rows by claim and system, the last one of each in a column a system."""
    rows = I.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("claim_id"), F.when(F.col("doc_id") % 2 == 0, "weak").otherwise("strong").alias("system"), F.col("n_chars").cast("long").alias("v"), "doc_id")
    return ranking.by_system(rows, "v", ["weak", "strong"], order="doc_id")


# -- splits and audits ----------------------------------------------------------------------


def _public(spark, d, whole=False):
    """Labelled documents as claims (their first line, or ``whole`` texts), with the documents of the same source and language bucket as evidence."""
    docs = I.table(spark, d, "documents")
    text = (F.col("text") if whole else F.get(F.split("text", "\n"), F.lit(0))).alias("text")
    claims = docs.where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("claim_id"), text)
    notes = docs.where("doc_id % 5 <> 0").select(
        ((F.col("doc_id") / 5).cast("long") * 5).cast("string").alias("claim_id"), F.col("doc_id").cast("string").alias("evidence_id"),
        F.when(F.col("doc_id") % 5 == 1, "SUPPORTS").otherwise("NOT_ENOUGH_INFO").alias("label"), text,
    )
    known = notes.join(claims.select("claim_id"), "claim_id", "left_semi").where("text is not null")
    return claims.where("text is not null"), known


_PUBLIC = """docs1 AS (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents WHERE text IS NOT NULL),
pc AS (SELECT CAST(doc_id AS VARCHAR) AS claim_id, text FROM docs1 WHERE doc_id % 5 = 0),
pa AS (SELECT CAST(doc_id // 5 * 5 AS VARCHAR) AS claim_id, CAST(doc_id AS VARCHAR) AS evidence_id, text, CASE WHEN doc_id % 5 = 1 THEN 'SUPPORTS' ELSE 'NOT_ENOUGH_INFO' END AS label FROM docs1 WHERE doc_id % 5 <> 0 AND doc_id // 5 * 5 IN (SELECT doc_id FROM documents))"""
_NORM = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"


@_query(f"WITH {_PUBLIC} SELECT DISTINCT evidence_id, text FROM pa")
def public_corpus(spark, d):
    return splitting.public_corpus(_public(spark, d)[1])


_FIXED = "sp AS (SELECT claim_id, CASE CAST(claim_id AS BIGINT) // 5 % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM pc)"


def _fixed_split(claims):
    turn = F.floor(F.col("claim_id").cast("long") / 5) % 4
    return claims.select("claim_id", F.when(turn == 0, "test").when(turn == 1, "validation").otherwise("train").alias("split"))


@_query(
    f"""WITH {_PUBLIC}, {_FIXED}, k AS (SELECT 'evidence' AS kind, {_NORM.format('text')} AS key, split FROM pa JOIN sp USING (claim_id)
    UNION ALL SELECT 'decisive', {_NORM.format('text')}, split FROM pa JOIN sp USING (claim_id) WHERE label = 'SUPPORTS' UNION ALL SELECT 'claim', {_NORM.format('text')}, split FROM pc JOIN sp USING (claim_id))
    SELECT kind, count(*) AS n FROM (SELECT kind, key FROM k GROUP BY ALL HAVING count(DISTINCT split) > 1) GROUP BY kind"""
)
def split_audit_counters(spark, d):
    """Normalised texts that several splits share, of claims, of evidence and of decisive evidence."""
    claims, notes = _public(spark, d)
    keys = splitting._keys(claims, notes, _fixed_split(claims))
    names = {"claim": "normalised_claim_duplicate_cross_split", "evidence": "normalised_evidence_text_cross_split", "decisive": "normalised_decisive_evidence_text_cross_split"}
    out = None
    for kind, name in names.items():
        one = splitting.straddling(keys[name]).groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@_query()
def grouped_public_split(spark, d):
    """Claims linked by equal or near whole texts and by shared or near evidence share a split."""
    return splitting.grouped_split(*_public(spark, d, whole=True)).select("claim_id", "split")


_EDGES = f"""near AS (SELECT a.id AS l, b.id AS r FROM nn a JOIN nn b ON a.id < b.id AND len(a.s) > 0 AND len(b.s) > 0 AND 100 * least(len(a.s), len(b.s)) >= 90 * greatest(len(a.s), len(b.s))
  AND 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""


@_query(
    f"""WITH RECURSIVE {_PUBLIC}, nn AS (SELECT 'c' || claim_id AS id, list_distinct({alnum('text')}) AS s FROM pc UNION ALL SELECT 'e' || evidence_id, list_distinct({alnum('text')}) FROM pa), {_EDGES},
    ee AS (SELECT l, r FROM near WHERE left(l, 1) = left(r, 1) UNION ALL SELECT 'c' || claim_id, 'e' || evidence_id FROM pa
      UNION ALL SELECT 'c' || claim_id, 'n' || {_NORM.format('text')} FROM pc UNION ALL SELECT 'c' || claim_id, 'm' || {_NORM.format('text')} FROM pa),
    e2 AS (SELECT l AS a, r AS b FROM ee UNION SELECT r, l FROM ee), reach AS (SELECT 'c' || claim_id AS id, 'c' || claim_id AS reach FROM pc UNION SELECT e2.b, reach.reach FROM reach JOIN e2 ON e2.a = reach.id)
    SELECT substr(id, 2) AS claim_id, substr(min(reach), 2) AS component FROM reach WHERE id LIKE 'c%' GROUP BY id"""
)
def public_components(spark, d):
    """The component of each claim over all five kinds of edges."""
    from ..operators.dedup import components

    claims, notes = _public(spark, d)
    return components(claims.select(F.col("claim_id").alias("id")), splitting.claim_edges(claims, notes)).select(F.col("id").alias("claim_id"), "component")


# -- hashes ---------------------------------------------------------------------------------


@_query("SELECT doc_id, sha256(unhex(lpad(to_hex(octet_length(encode(source))), 16, '0') || hex(encode(source)) || lpad(to_hex(octet_length(encode(text))), 16, '0') || hex(encode(text)))) AS framed_sha256 FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def framed_hash(spark, d):
    """SHA-256 of length-framed values, which no other values give."""
    rows = I.table(spark, d, "documents").where("source is not null and text is not null")
    return rows.select("doc_id", F.sha2(F.concat(framed_column(F.col("source")), framed_column(F.col("text"))), 256).alias("framed_sha256"))


# -- the dense route ------------------------------------------------------------------------


@_query()
def hash_dense_topk(spark, d):
    """Hash-encoded claims against hash-encoded documents."""
    return rounded(I.hash_route(spark, d).select("query_id", "doc_id", "score", "rank"))


@_query()
def hybrid_reranked(spark, d):
    """BM25 and the dense route fused, reranked by overlap."""
    routes = {"bm25": I.bm25(spark, d), "dense": I.hash_route(spark, d, I.WIDTH)}
    return rounded(hybrid(routes, reranker=protocols.OverlapReranker(), claims=I.claims(spark, d), docs=I.documents(spark, d)))


# -- training, serving ----------------------------------------------------------------------


@_query(
    f"""{_FEATURES}, g AS (SELECT DISTINCT query_id FROM gold), r AS (SELECT DISTINCT f.query_id FROM f JOIN gold USING (query_id, doc_id)), a AS (SELECT DISTINCT query_id FROM f)
    SELECT CASE WHEN r.query_id IS NOT NULL THEN 'supported' WHEN g.query_id IS NOT NULL THEN 'unsupported' ELSE 'skipped' END AS kind, count(*) AS n FROM a LEFT JOIN r USING (query_id) LEFT JOIN g USING (query_id) GROUP BY 1"""
)
def mined_claim_kinds(spark, d):
    return ranking.mined_rows(_features(spark, d), I.gold(spark, d))[1]


@_query()
def infonce_messages(spark, d):
    """Rows of messages with four hard negatives, and the side of the split."""
    neg = I.bm25(spark, d, 20).select("query_id", "doc_id", "rank")
    rows, _ = training.infonce_rows(I.claims(spark, d), I.documents(spark, d), I.gold(spark, d), neg, instruction="Find evidence.")
    return rows.select("query_id", "doc_id", "in_eval", F.size("negatives").alias("n_negatives"), F.size("messages").alias("n_messages"))


@_query(
    """WITH e AS (SELECT event_type AS route, CASE WHEN event_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status, ts, round(value, 3) AS ms FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, ms DESC) AS age FROM e),
    r AS (SELECT route, ms, row_number() OVER (PARTITION BY route ORDER BY ms) AS n, count(*) OVER (PARTITION BY route) AS m FROM o WHERE age <= 10000), p AS (SELECT 'p50' AS n, 5e-1 AS q UNION ALL SELECT 'p95', 95e-2)
    SELECT 'requests_total{route="' || route || '",status="' || status || '"} ' || count(*) AS line FROM e GROUP BY route, status
    UNION ALL SELECT 'requests_latency_ms{route="' || route || '",quantile="' || p.n || '"} ' || printf('%.6f', ms) FROM r, p WHERE r.n = least(m - 1, CAST(floor(q * m) AS BIGINT)) + 1"""
)
def service_metrics(spark, d):
    e = I.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("route"), F.when(F.col("event_id") % 10 == 0, "error").otherwise("ok").alias("status"), F.col("ts").alias("at"), F.round("value", 3).alias("ms"))
    return serving.prometheus_lines(rows)


@_query()
def answers_with_retry(spark, d):
    """Claims searched, and searched again by their parts where coverage is low."""
    index = I.index(spark, d)
    found, _ = serving.answered(I.claims(spark, d), I.documents(spark, d), index.search)
    return rounded(found.select("query_id", "doc_id", "score", "rank"))


@_query()
def gated_verdicts(spark, d):
    """Fixture verdicts behind the coverage gate, with their citations checked."""
    claims = I.claims(spark, d)
    ranked, covered = serving.answered(claims, I.documents(spark, d), I.index(spark, d).search, max_queries=1)
    evidence = ranked.join(I.documents(spark, d), "doc_id").select("query_id", "doc_id", "text", "rank")
    return rounded(serving.verdicts(claims, evidence, covered, protocols.FixtureVerifier(), least=0.5))


@_query("SELECT item_id AS query_id, 'NOT_ENOUGH_INFO' AS label, 0e0 AS confidence, 'verifier_not_configured' AS abstain_reason FROM benchmark")
def abstaining_verdicts(spark, d):
    none = I.claims(spark, d).select("query_id", F.lit(0).alias("doc_id"), "text", F.lit(1).alias("rank"))
    return protocols.AbstainingVerifier().verify(I.claims(spark, d), none).select("query_id", "label", "confidence", "abstain_reason")


@_query("SELECT item_id AS query_id, length(text) BETWEEN 1 AND 10000 AS accepted FROM benchmark")
def request_checks(spark, d):
    n = F.length("text")
    return I.claims(spark, d).select("query_id", ((n >= 1) & (n <= serving.LONGEST_TEXT)).alias("accepted"))


@_query(f"WITH t AS (SELECT item_id AS query_id, text FROM benchmark) SELECT query_id, '[{{\"role\":\"system\",\"content\":\"Find evidence.\"}},{{\"role\":\"user\",\"content\":\"' || text || '\"}}]' AS messages FROM t WHERE regexp_full_match(text, '[A-Za-zäöüßéèêçñóíáà .,]*')")
def claim_messages(spark, d):
    c = I.claims(spark, d).where(F.col("text").rlike("^[A-Za-zäöüßéèêçñóíáà .,]*$"))
    return c.select("query_id", F.to_json(training.messages(F.col("text"), "Find evidence.")).alias("messages"))
