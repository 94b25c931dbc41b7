"""More queries of the catalogue: ranking models, calibration, sets, governance, serving."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts, dedup, fusion, metrics, ranking, verify
from ..operators.retrieval import coverage, dense_top_k, recall_at_k
from . import inputs as I  # noqa: E741
from .catalogue import _FEATURES, BM, _features, _query, _rankings, _routes, alnum, rounded

_SOME = ["token_overlap", "bm25_score", "document_length"]
_VERDICTS = """v AS (SELECT doc_id AS query_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTS' WHEN quality = 0 THEN 'REFUTES' ELSE 'NOT_ENOUGH_INFO' END AS gold, doc_id FROM labels),
vv AS (SELECT query_id, gold, CASE WHEN doc_id * 7 % 10 < 7 THEN gold WHEN doc_id * 7 % 10 = 7 THEN 'SUPPORTS' WHEN doc_id * 7 % 10 = 8 THEN 'REFUTES' ELSE 'NOT_ENOUGH_INFO' END AS predicted,
  (doc_id * 37 % 100) / 100e0 AS confidence FROM v)"""
_SPLIT = """s AS (SELECT doc_id, text, CASE WHEN f < 7 THEN 'train' WHEN f < 9 THEN 'validation' ELSE 'test' END AS split FROM
  (SELECT doc_id, text, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 10 AS f FROM documents))"""


# -- ranking models -------------------------------------------------------------------------


def _relevance(spark, d):
    gold = I.gold(spark, d).withColumn("relevance", F.lit(2))
    return _features(spark, d).join(gold, ["query_id", "doc_id"], "left").fillna(0, ["relevance"])


@_query(
    f"""{_FEATURES}, g AS (SELECT f.*, CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 2 END AS relevance FROM f LEFT JOIN gold USING (query_id, doc_id))
    SELECT a.query_id, a.doc_id AS better, b.doc_id AS worse, {', '.join(f'round(a.{x} - b.{x}, 6) AS {x}' for x in _SOME)} FROM g a JOIN g b ON a.query_id = b.query_id AND a.relevance > b.relevance"""
)
def ltr_pairs(spark, d):
    return rounded(ranking.pairs(_relevance(spark, d), _SOME))


@_query(f"{_FEATURES} SELECT query_id, doc_id, round(2e0 * token_overlap + 1e-1 * bm25_score - 1e-3 * document_length, 6) AS score FROM f")
def ltr_scores(spark, d):
    weights = {"algorithm": "linear-pairwise", "features": _SOME, "weights": [2.0, 0.1, -0.001], "stats": {}}
    return rounded(_features(spark, d).select("query_id", "doc_id", ranking.PairwiseRanker.from_dict(weights).score().alias("score")))


@_query(
    f"""{_FEATURES}, g AS (SELECT query_id, f.doc_id, bm25_score, CASE WHEN gold.doc_id IS NULL THEN 0 ELSE 2 END AS relevance FROM f LEFT JOIN gold USING (query_id, doc_id))
    SELECT count(*) AS n_pairs, round(coalesce(avg(CASE WHEN a.bm25_score > b.bm25_score THEN 1e0 ELSE 0e0 END), 0), 6) AS accuracy FROM g a JOIN g b ON a.query_id = b.query_id AND a.relevance > b.relevance"""
)
def pairwise_accuracy(spark, d):
    return rounded(ranking.pairwise_accuracy(_relevance(spark, d).withColumn("score", F.col("bm25_score"))))


@_query()
def ltr_fit(spark, d):
    rows = _relevance(spark, d).persist()
    model = ranking.PairwiseRanker(_SOME, epochs=300).fit(rows)
    return rows.select("query_id", "doc_id", F.round(model.score(), 6).alias("score"))


@_query(
    f"""WITH {BM}, j AS (SELECT query_id, br.rank AS lr, ovr.rank AS rr FROM br FULL JOIN ovr USING (query_id, doc_id))
    SELECT query_id, {', '.join(f'sum(CASE WHEN lr <= {k} AND rr <= {k} THEN 1 ELSE 0 END) / {k}e0 AS bm25_dense_overlap_at_{k}' for k in (1, 3, 5))},
    round(coalesce(sum(2e0 / (lr + rr)), 0) / greatest(count(lr), count(rr), 1), 6) AS bm25_dense_rank_agreement FROM j GROUP BY query_id"""
)
def router_agreement_features(spark, d):
    r = _routes(spark, d)
    return rounded(ranking.agreement_features(r["bm25"], r["overlap"], ("bm25", "dense")))


def _gains(spark, d):
    return I.verdicts(spark, d).select(F.col("query_id").alias("id"), F.round("confidence", 1).alias("predicted"), ((F.col("query_id") * 13 % 7) / 7.0 - 0.2).alias("observed"))


@_query(
    f"""WITH {_VERDICTS}, g AS (SELECT round(confidence, 1) AS predicted, (query_id * 13 % 7) / 7e0 - 2e-1 AS observed FROM vv), p AS (SELECT predicted, count(*) AS n, sum(observed) AS gain FROM g GROUP BY 1)
    SELECT predicted, round(sum(n) OVER (ORDER BY predicted DESC) / (SELECT count(*) FROM g), 6) AS rate, round(sum(gain) OVER (ORDER BY predicted DESC) / (SELECT count(*) FROM g), 6) AS mean_gain FROM p"""
)
def threshold_curve(spark, d):
    return rounded(ranking.threshold_curve(_gains(spark, d).select("predicted", "observed")))


@_query()
def ridge_crossfit(spark, d):
    rows = I.verdicts(spark, d).select(
        F.col("query_id").alias("id"), "confidence", (F.col("gold") == "SUPPORTS").cast("double").alias("supported"),
        (F.col("gold") != F.col("predicted")).cast("double").alias("gain"),
    )
    return rounded(ranking.cross_fit(rows, ["confidence", "supported"]))


# -- calibration and verification -----------------------------------------------------------


@_query(
    f"""WITH {_VERDICTS}, one AS (SELECT avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END) AS accuracy, avg((confidence - CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END) ** 2) AS brier FROM vv),
    l AS (SELECT label, sum(CASE WHEN gold = label AND predicted = label THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) AS pn, sum(CASE WHEN gold = label THEN 1 ELSE 0 END) AS gn
      FROM vv CROSS JOIN (VALUES ('SUPPORTS'), ('REFUTES'), ('NOT_ENOUGH_INFO')) t(label) GROUP BY label),
    m AS (SELECT label, gn, coalesce(tp / CAST(nullif(pn, 0) AS DOUBLE), 0) AS p, coalesce(tp / CAST(nullif(gn, 0) AS DOUBLE), 0) AS r FROM l),
    n AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f1 FROM m)
    SELECT round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round((SELECT avg(f1) FROM n), 6) AS macro_f1, label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(gn AS BIGINT) AS n_gold FROM n CROSS JOIN one"""
)
def verification_metrics(spark, d):
    return rounded(metrics.verification_scores(I.verdicts(spark, d)))


@_query(
    f"""WITH {_VERDICTS}, e AS (SELECT i AS bin, i * 1e-1 AS lo, (i + 1) * 1e-1 AS hi FROM range(10) t(i)),
    b AS (SELECT bin, count(*) AS n, avg(confidence) AS confidence, avg(CASE WHEN gold = predicted THEN 1e0 ELSE 0e0 END) AS accuracy FROM vv JOIN e ON confidence >= lo AND (confidence < hi OR (bin = 9 AND confidence <= hi)) GROUP BY bin)
    SELECT CAST(bin AS INTEGER) AS bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy) * n / sum(n) OVER (), 6) AS gap FROM b"""
)
def ece_bins(spark, d):
    return rounded(metrics.calibration_bins(I.verdicts(spark, d)))


_LOGITS = "x AS (SELECT vec_id, label % 3 AS label, list_transform(CAST(embedding[1:3] AS DOUBLE[]), lambda v: v * 10) AS l FROM embeddings)"


@_query(
    f"""WITH {_LOGITS}, y AS (SELECT vec_id, list_transform(l, lambda v: exp((v - list_max(l)) / 2e0)) AS e FROM x)
    SELECT vec_id AS query_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2 FROM y"""
)
def softmax(spark, d):
    p = T.softmax(F.col("logits"), 2.0)
    return rounded(I.logits(spark, d).select("query_id", *[p[k].alias(f"p{k}") for k in range(3)]))


@_query(
    f"""WITH {_LOGITS}, g AS (SELECT 5e-2 * pow(200e0, i / 20e0) AS t FROM range(21) r(i)),
    z AS (SELECT t, -ln(greatest(exp((l[label + 1] - list_max(l)) / t) / list_sum(list_transform(l, lambda v: exp((v - list_max(l)) / t))), 1e-15)) AS loss FROM x CROSS JOIN g)
    SELECT round(t, 6) AS temperature, round(avg(loss), 6) AS nll FROM z GROUP BY t"""
)
def temperature_grid(spark, d):
    return rounded(metrics.temperature_grid(I.logits(spark, d), steps=21))


@_query(
    f"""WITH {_VERDICTS}, w AS (SELECT query_id, confidence, row_number() OVER o AS n, sum(CASE WHEN gold <> predicted THEN 1 ELSE 0 END) OVER o AS wrong FROM vv WINDOW o AS (ORDER BY confidence DESC, query_id ROWS UNBOUNDED PRECEDING))
    SELECT query_id, round(n / (SELECT count(*) FROM vv), 6) AS coverage, round(wrong / n, 6) AS risk, round(1 - wrong / n, 6) AS accuracy, confidence AS threshold FROM w"""
)
def selective_risk(spark, d):
    return rounded(metrics.selective_risk(I.verdicts(spark, d)))


@_query(
    f"""WITH {BM}, p AS (SELECT query_id, doc_id FROM br WHERE rank <= 3), j AS (SELECT query_id, gold.doc_id AS g, p.doc_id AS p FROM gold FULL JOIN p USING (query_id, doc_id)),
    c AS (SELECT query_id, count(g) AS g, count(p) AS p, sum(CASE WHEN g IS NOT NULL AND p IS NOT NULL THEN 1 ELSE 0 END) AS b FROM j GROUP BY 1),
    r AS (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(b, 0) AS b FROM q LEFT JOIN c USING (query_id)),
    o AS (SELECT sum(b) / nullif(sum(p), 0) AS p, sum(b) / nullif(sum(g), 0) AS r, avg(CASE WHEN g > 0 AND b = g THEN 1e0 ELSE 0e0 END) AS completeness FROM r)
    SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(completeness, 6) AS completeness FROM o"""
)
def citation_metrics(spark, d):
    return rounded(metrics.citation_scores(I.gold(spark, d), I.bm25(spark, d, 3), I.claims(spark, d)))


@_query(
    """WITH a AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part),
    b AS (SELECT a.p_partkey, count(*) AS n FROM a JOIN a b ON a.p_brand = b.p_brand AND b.size >= a.size AND b.price <= a.price AND (b.size > a.size OR b.price < a.price) GROUP BY 1)
    SELECT p_partkey, p_brand, coalesce(n, 0) AS dominated_by, coalesce(n, 0) = 0 AS on_front FROM a LEFT JOIN b USING (p_partkey)"""
)
def pareto_front(spark, d):
    out = metrics.pareto_front(I.table(spark, d, "part"), group="p_brand", name="p_partkey", maximise=["p_size"], minimise=["p_retailprice"])
    return out.select("p_partkey", "p_brand", "dominated_by", "on_front")


@_query("SELECT event_type, round(quantile_cont(value, 5e-1), 6) AS p50, round(quantile_cont(value, 95e-2), 6) AS p95 FROM events GROUP BY 1")
def percentile_linear(spark, d):
    e = I.table(spark, d, "events").groupBy("event_type")
    return rounded(e.agg(F.percentile("value", F.lit(0.5)).alias("p50"), F.percentile("value", F.lit(0.95)).alias("p95")))


@_query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events)
    SELECT event_type, value FROM r WHERE n = least(floor(95e-2 * m), m - 1) + 1"""
)
def percentile_nearest_rank(spark, d):
    return metrics.nearest_rank(I.table(spark, d, "events"), 0.95, by="event_type", value="value")


def _paired(spark, d):
    gold, claims = I.gold(spark, d), I.claims(spark, d)
    r = _routes(spark, d)
    a = metrics.retrieval_metrics(claims, r["overlap"], gold).select(F.col("query_id").alias("id"), F.col("mrr_10").alias("base"))
    b = metrics.retrieval_metrics(claims, r["bm25"], gold).select(F.col("query_id").alias("id"), F.col("mrr_10").alias("candidate"))
    return a.join(b, "id")


@_query()
def paired_bootstrap(spark, d):
    return rounded(metrics.paired_bootstrap(_paired(spark, d).withColumn("metric", F.lit("mrr_10")), by="metric", samples=2000))


@_query(
    """WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, CAST(quality AS DOUBLE) - CAST(toxic AS DOUBLE) AS x FROM labels), n AS (SELECT count(*) AS n FROM v),
    g AS (SELECT s, (((7919 * s + 104729 * p + 17) * 40503) % 4294967296 // 65536) % n AS i FROM range(2000) a(s), n, LATERAL range(n.n) b(p)),
    m AS (SELECT s, avg(x) AS m FROM g JOIN v USING (i) GROUP BY s)
    SELECT round(avg(m), 6) AS mean_difference, round(quantile_cont(m, 25e-3), 6) AS ci_lower, round(quantile_cont(m, 975e-3), 6) AS ci_upper FROM m"""
)
def bootstrap_hash(spark, d):
    rows = I.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") - F.col("toxic")).cast("double").alias("difference"))
    return rounded(metrics.hash_bootstrap(rows, samples=2000))


# -- taxonomy -------------------------------------------------------------------------------


@_query()
def query_taxonomy(spark, d):
    q = I.claims(spark, d)
    text = F.col("text")
    best = (
        I.gold(spark, d)
        .join(q.select("query_id", T.alnum_tokens(text).alias("qt")), "query_id")
        .join(I.documents(spark, d).select("doc_id", T.alnum_tokens(text).alias("dt")), "doc_id")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n"), F.max(T.jaccard(F.array_distinct("qt"), F.array_distinct("dt"))).alias("overlap"),
            F.max(T.has_spelling_variant(F.col("qt"), F.col("dt"))).alias("spelling"),
        )
    )
    norm = T.normalised(text)
    place = F.exists(F.array(*[F.lit(t) for t in T.GEOGRAPHIC_TERMS]), lambda t: F.contains(norm, t))
    n, overlap = F.coalesce("n", F.lit(0)), F.coalesce("overlap", F.lit(0.0))
    tags = {
        "spelling": F.coalesce("spelling", F.lit(False)),
        "entity": text.rlike(r"\b[A-Z]{2,}\b|(?:^|[.!?]\s+)[A-Z][a-z]+\s+[A-Z][a-z]+"),
        "year_or_numeric": text.rlike(r"\b(?:18|19|20)\d{2}\b|\b\d+(?:\.\d+)?%?\b"),
        "geographic": place,
        "lexical_mismatch": (n > 0) & (overlap < 0.15),
        "semantic_paraphrase": (n > 0) & (overlap < 0.30),
        "multi_evidence": n > 1,
        "unanswerable": n == 0,
    }
    listed = F.array_compact(F.array(*[F.when(tags[t], F.lit(t)) for t in metrics.TAXONOMY]))
    return q.join(best, "query_id", "left").select("query_id", F.array_join(listed, ",").alias("tags"))


@_query()
def taxonomy_slices(spark, d):
    per = metrics.retrieval_metrics(I.claims(spark, d), I.bm25(spark, d), I.gold(spark, d))
    tagged = query_taxonomy(spark, d).select("query_id", F.explode(F.split("tags", ",")).alias("tag"))
    return rounded(tagged.join(per, "query_id").groupBy("tag").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("recall_5", "mrr_10", "ndcg_10", "evidence_f1")]))


# -- sets, splits, leakage ------------------------------------------------------------------


@_query("SELECT sha256(text) AS text_sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return I.documents(spark, d).groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_PAIRS = f"""w AS (SELECT doc_id, list_distinct({alnum('text')}) AS s FROM documents), p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM w a JOIN w b ON a.doc_id < b.doc_id
  AND len(a.s) > 0 AND len(b.s) > 0 AND 100 * least(len(a.s), len(b.s)) >= 90 * greatest(len(a.s), len(b.s))
  AND 100 * len(list_intersect(a.s, b.s)) >= 90 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))"""


@_query(f"WITH {_PAIRS} SELECT * FROM p")
def near_dup_pairs(spark, d):
    return dedup.near_duplicate_pairs(I.documents(spark, d))


@_query(
    f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT left_id AS a, right_id AS b FROM p UNION ALL SELECT right_id, left_id FROM p),
    r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT e.a, r.reach FROM e JOIN r ON r.id = e.b)
    SELECT id, min(reach) AS component FROM r GROUP BY id"""
)
def dedup_components(spark, d):
    docs = I.documents(spark, d)
    return dedup.components(docs.select(F.col("doc_id").alias("id")), dedup.near_duplicate_links(docs))


@_query(f"WITH {_SPLIT} SELECT split, count(*) AS n, count(DISTINCT text) AS n_texts FROM s GROUP BY split")
def split_counts(spark, d):
    return I.splits(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@_query(f"WITH {_SPLIT} SELECT sha256(text) AS key, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM s GROUP BY text HAVING count(DISTINCT split) > 1")
def leakage_audit(spark, d):
    return dedup.leakage(I.splits(spark, d).withColumn("key", F.sha2("text", 256)), split="split", key="key")


@_query()
def grouped_split(spark, d):
    parts = dedup_components(spark, d).persist()
    sizes = [(r[0], r[1]) for r in parts.groupBy("component").count().collect()]
    names = dedup.grouped_split(sizes)
    placed = spark.createDataFrame(list(names.items()), "component long, split string")
    return parts.join(placed, "component").select("id", "split")


# -- governance -----------------------------------------------------------------------------


@_query(
    f"""WITH {_SPLIT}, t AS (SELECT source, split FROM s JOIN documents USING (doc_id)), a AS (SELECT source, count(*) / sum(count(*)) OVER () AS p FROM t WHERE split = 'train' GROUP BY 1),
    b AS (SELECT source, count(*) / sum(count(*)) OVER () AS q FROM t WHERE split = 'test' GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS total_variation FROM a FULL JOIN b USING (source)"""
)
def total_variation(spark, d):
    rows = I.splits(spark, d).join(I.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    side = lambda s: rows.where(F.col("split") == s).groupBy("source").agg(F.count("*").alias("n"))
    return rounded(metrics.total_variation(side("train"), side("test"), key="source"))


_PILOT = "a AS (SELECT s_nationkey AS id, avg(s_acctbal) AS recall_delta, min(s_acctbal) AS ndcg_delta FROM supplier GROUP BY 1)"


def _pilots(spark, d) -> dict[str, dict[str, float]]:
    """Two numbers for each of the 25 nations, as pilots' metric differences."""
    a = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.avg("s_acctbal").alias("r"), F.min("s_acctbal").alias("n"))
    return {f"{r['id']:04d}": {"recall@5": r["r"], "ndcg@10": r["n"]} for r in a.collect()}


@_query(
    f"""WITH {_PILOT}, g AS (SELECT *, recall_delta > 0 AND ndcg_delta >= 0 AS good FROM a), o AS (SELECT *, row_number() OVER (ORDER BY good DESC, recall_delta DESC, ndcg_delta DESC, id) AS place FROM g)
    SELECT CAST(id AS BIGINT) AS id, CAST(place AS INTEGER) AS place, NOT good AS diagnostic FROM o WHERE good AND place <= 2 OR NOT good AND place = 1"""
)
def pilot_selection(spark, d):
    chosen, diagnostic = contracts.advance(_pilots(spark, d))
    rows = [(int(p), k, False) for k, p in enumerate(chosen, 1)] + ([(int(diagnostic), 1, True)] if diagnostic else [])
    return spark.createDataFrame(rows, "id long, place int, diagnostic boolean")


@_query(f"WITH {_PILOT} SELECT CAST(id AS BIGINT) AS id, recall_delta > 1e3 AND recall_delta > 0 AND ndcg_delta >= 0 AS promoted FROM a")
def promotion_decision(spark, d):
    runs = {p: {"recall@5": {"mean_difference": m["recall@5"], "ci_lower": m["recall@5"] - 1000}, "ndcg@10": {"mean_difference": m["ndcg@10"]}} for p, m in _pilots(spark, d).items()}
    return spark.createDataFrame([(int(p), contracts.promoted(r)) for p, r in runs.items()], "id long, promoted boolean")


@_query(
    f"""WITH {BM}, a AS (SELECT query_id, doc_id, min(rank) AS best FROM (SELECT query_id, doc_id, rank FROM br UNION ALL SELECT query_id, doc_id, rank FROM ovr) ANTI JOIN gold USING (query_id, doc_id) GROUP BY ALL),
    n AS (SELECT a.*, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS h FROM a JOIN documents USING (doc_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY best, doc_id) AS k FROM n),
    r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) AS nth FROM o WHERE k = 1)
    SELECT query_id, gold.doc_id AS positive, string_agg(r.doc_id, ',' ORDER BY nth) AS negatives FROM gold JOIN r USING (query_id) WHERE nth <= 4 GROUP BY ALL HAVING count(*) = 4"""
)
def infonce_rows(spark, d):
    """A row for each gold pair with its first four negatives of distinct normalised text."""
    neg = _rankings(spark, d).join(I.gold(spark, d), ["query_id", "doc_id"], "left_anti").groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    texts = I.documents(spark, d).select("doc_id", F.md5(F.lower(T.collapsed(F.col("text")))).alias("h"))
    order = lambda *by: Window.partitionBy(*by).orderBy("best", "doc_id")
    once = neg.join(texts, "doc_id").withColumn("k", F.row_number().over(order("query_id", "h"))).where("k = 1")
    first = once.withColumn("nth", F.row_number().over(order("query_id"))).where("nth <= 4")
    listed = first.groupBy("query_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nth", "doc_id"))).alias("l")).where("n = 4")
    ids = F.array_join(F.transform(F.col("l"), lambda x: x["doc_id"].cast("string")), ",")
    return I.gold(spark, d).join(listed, "query_id").select("query_id", F.col("doc_id").alias("positive"), ids.alias("negatives"))


@_query("SELECT conv_id, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING count(*) = 1")
def heldout_claims(spark, d):
    c = I.table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy("conv_id").agg(F.min("text").alias("text"), F.count("*").alias("n")).where("n = 1").drop("n")


# -- serving --------------------------------------------------------------------------------


@_query(
    f"""WITH {BM}, c AS (SELECT q.query_id, list_distinct(q.toks) AS t, list_distinct(flatten(list(d.toks))) AS e FROM q JOIN br ON br.query_id = q.query_id AND rank <= 3 JOIN d ON d.doc_id = br.doc_id GROUP BY q.query_id, q.toks)
    SELECT query_id, round(len(list_intersect(t, e)) / CAST(len(t) AS DOUBLE), 6) AS coverage FROM c"""
)
def evidence_coverage(spark, d):
    return rounded(_coverage(spark, d))


def _coverage(spark, d):
    docs = I.documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("dt"))
    found = I.bm25(spark, d, 3).join(docs, "doc_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("dt"))).alias("e"))
    q = I.claims(spark, d).select("query_id", T.tokens(F.col("text")).alias("qt"))
    return q.join(found, "query_id").select("query_id", coverage(F.col("qt"), F.col("e")).alias("coverage"))


@_query(
    f"""WITH {BM}, c AS (SELECT q.query_id, list_distinct(q.toks) AS t, list_distinct(flatten(list(d.toks))) AS e FROM q JOIN br ON br.query_id = q.query_id AND rank <= 3 JOIN d ON d.doc_id = br.doc_id GROUP BY q.query_id, q.toks),
    v AS (SELECT query_id, len(list_intersect(t, e)) / CAST(len(t) AS DOUBLE) AS coverage FROM c)
    SELECT query_id, round(coverage, 6) AS coverage, CASE WHEN coverage < 9e-1 THEN 'NOT_ENOUGH_INFO' ELSE 'SUPPORTS' END AS label, CASE WHEN coverage < 9e-1 THEN 0e0 ELSE 9e-1 END AS confidence,
    CASE WHEN coverage < 9e-1 THEN 'insufficient_evidence_coverage' END AS abstain_reason FROM v"""
)
def verdict_gate(spark, d):
    rows = _coverage(spark, d).withColumn("label", F.lit("SUPPORTS")).withColumn("confidence", F.lit(0.9))
    return rounded(verify.gate(rows, least=0.9))


def _norm(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


@_query(
    f"""WITH {BM}, e AS (SELECT br.query_id, doc_id, text FROM br JOIN documents USING (doc_id) WHERE rank <= 2), c AS (SELECT query_id, doc_id, q.text AS quote FROM br JOIN q USING (query_id) WHERE rank <= 1
      UNION ALL SELECT query_id, -1, 'x' FROM q WHERE query_id % 5 = 0),
    v AS (SELECT c.query_id, c.doc_id, e.text IS NOT NULL AS known, e.text IS NOT NULL AND {_norm('quote')} <> '' AND contains({_norm('e.text')}, {_norm('quote')}) AS valid FROM c LEFT JOIN e USING (query_id, doc_id)),
    w AS (SELECT query_id, CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS INTEGER) AS n_valid, list(DISTINCT CASE WHEN NOT known THEN 'unknown_citation:' || doc_id WHEN NOT valid THEN 'invalid_quote:' || doc_id END) AS w FROM v GROUP BY 1),
    x AS (SELECT query_id, n_valid, list_sort(list_filter(list_append(w, CASE WHEN n_valid = 0 THEN 'verdict_without_valid_citation' END), lambda z: z IS NOT NULL)) AS w FROM w)
    SELECT query_id, CASE WHEN len(w) > 0 THEN 'NOT_ENOUGH_INFO' ELSE 'SUPPORTS' END AS label, CASE WHEN len(w) > 0 THEN 0e0 ELSE 9e-1 END AS confidence, n_valid, CASE WHEN len(w) > 0 THEN array_to_string(w, ';') END AS abstain_reason FROM x"""
)
def citation_validation(spark, d):
    top = I.bm25(spark, d, 2)
    evidence = top.join(I.documents(spark, d), "doc_id").select("query_id", "doc_id", "text")
    q = I.claims(spark, d)
    cited = top.where("rank = 1").join(q, "query_id").select("query_id", "doc_id", F.col("text").alias("quote"))
    cited = cited.unionByName(q.where("query_id % 5 = 0").select("query_id", F.lit(-1).cast("long").alias("doc_id"), F.lit("x").alias("quote")))
    results = q.select("query_id", F.lit("SUPPORTS").alias("label"), F.lit(0.9).alias("confidence"))
    return verify.check_citations(results, cited, evidence)


@_query()
def bounded_re_retrieval(spark, d):
    """Claims with low coverage are asked again by their parts; all lists are fused."""
    index = I.index(spark, d)
    q = I.claims(spark, d)
    low = _coverage(spark, d).where(F.col("coverage") < verify.RETRY_COVERAGE).select("query_id")
    parts = q.join(low, "query_id").select("query_id", F.posexplode(T.decomposed(F.col("text"))).alias("part", "text"))
    again = index.search(parts.select(F.struct("query_id", "part").alias("query_id"), "text"), 10)
    lists = index.search(q, 10).select("query_id", F.lit(-1).alias("source"), "doc_id", "rank").unionByName(
        again.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.part").alias("source"), "doc_id", "rank")
    )
    return rounded(fusion.reciprocal_rank_fusion(lists, top=5))


@_query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10000 GROUP BY 1")
def route_latency(spark, d):
    rows = I.latest(I.table(spark, d, "events"), by="event_type", order="ts", keep=10000)
    return rounded(rows.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@_query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000")
def trace_retention(spark, d):
    return I.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "event_type")


@_query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS m FROM events)
    SELECT 'requests_total{route="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type
    UNION ALL SELECT 'latency_p50{route="' || event_type || '"} ' || printf('%.3f', value) FROM r WHERE n = least(floor(5e-1 * m), m - 1) + 1"""
)
def prometheus_text(spark, d):
    e = I.table(spark, d, "events")
    total = e.groupBy("event_type").count().select(F.format_string('requests_total{route="%s"} %d', "event_type", "count").alias("line"))
    p50 = metrics.nearest_rank(e, 0.5, by="event_type", value="value").select(F.format_string('latency_p50{route="%s"} %.3f', "event_type", "value").alias("line"))
    return total.unionByName(p50)


@_query()
def ann_recall(spark, d):
    """Recall of a search over the cells nearest to each query, against the exact one."""
    from ..operators.ann import ivf_top_k

    e = I.table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0")
    return rounded(recall_at_k(dense_top_k(e, q, 10), ivf_top_k(e, q, 10, cells=16, probes=8), 10))


@_query()
def ivf_topk(spark, d):
    from ..operators.ann import ivf_top_k

    e = I.table(spark, d, "embeddings")
    return rounded(ivf_top_k(e, e.where("vec_id % 20 = 0"), 10, cells=16, probes=8).select("query_id", "doc_id", "score", "rank"))


@_query()
def hash_encode(spark, d):
    from ..operators.ann import hash_encoded

    return rounded(hash_encoded(I.documents(spark, d)))




# -- candidates, samples and seals ----------------------------------------------------------


@_query(
    f"""WITH {BM}, p AS (SELECT query_id, gold.doc_id, list_distinct(q.toks) AS a, list_distinct(d.toks) AS b FROM gold JOIN q USING (query_id) JOIN d ON d.doc_id = gold.doc_id)
    SELECT query_id, doc_id, round(len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE), 6) AS overlap, round(len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE), 6) AS jaccard FROM p"""
)
def overlap_features(spark, d):
    q = I.claims(spark, d).select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("a"))
    docs = I.documents(spark, d).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("b"))
    pairs = I.gold(spark, d).join(q, "query_id").join(docs, "doc_id")
    return rounded(pairs.select("query_id", "doc_id", T.overlap_ratio(F.col("a"), F.col("b")).alias("overlap"), T.jaccard(F.col("a"), F.col("b")).alias("jaccard")))


@_query(
    f"""WITH {BM} SELECT count(*) AS n_gold, count(rrf.doc_id) AS n_reached, count(DISTINCT gold.query_id) AS n_claims, count(DISTINCT CASE WHEN rrf.doc_id IS NOT NULL THEN gold.query_id END) AS n_claims_reached
    FROM gold LEFT JOIN rrf USING (query_id, doc_id)"""
)
def candidate_reachability(spark, d):
    found = fusion.reciprocal_rank_fusion(_rankings(spark, d), top=50).select("query_id", "doc_id").withColumn("hit", F.lit(1))
    joined = I.gold(spark, d).join(found, ["query_id", "doc_id"], "left")
    return joined.agg(
        F.count("*").alias("n_gold"), F.count("hit").alias("n_reached"), F.count_distinct("query_id").alias("n_claims"),
        F.count_distinct(F.when(F.col("hit").isNotNull(), F.col("query_id"))).alias("n_claims_reached"),
    )


@_query(f"WITH {_SPLIT} SELECT split, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS ids_sha256 FROM s GROUP BY split")
def split_seal(spark, d):
    """Count and hash of each split's ids, so that a sealed split can be named without being written."""
    ids = F.array_sort(F.collect_list("doc_id"))
    text = F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
    return I.splits(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sha2(text, 256).alias("ids_sha256"))


@_query(
    f"""WITH {BM} SELECT query_id, '{{"claim_id":' || query_id || ',"evidences":[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) || ']}}' AS line FROM br WHERE rank <= 5 GROUP BY query_id"""
)
def prediction_export(spark, d):
    """One JSON object a claim with its first five documents in order."""
    ranked = I.bm25(spark, d, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    line = F.to_json(F.struct(F.col("query_id").alias("claim_id"), F.col("r.doc_id").alias("evidences")))
    return ranked.select("query_id", line.alias("line"))


@_query(
    """WITH gold AS (SELECT DISTINCT doc_id FROM documents JOIN benchmark b ON contains(documents.text, b.text)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('17:' || doc_id), doc_id) AS n FROM documents ANTI JOIN gold USING (doc_id))
    SELECT doc_id, TRUE AS required FROM gold UNION ALL SELECT doc_id, FALSE FROM r WHERE n <= 200 - (SELECT count(*) FROM gold)"""
)
def evidence_sample(spark, d):
    """All required documents, and others up to 200 in the order of a hash."""
    need = I.gold(spark, d).select("doc_id").distinct()
    rest = I.documents(spark, d).select("doc_id").join(need, "doc_id", "left_anti")
    more = rest.orderBy(F.sha2(F.concat(F.lit("17:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(max(0, 200 - need.count()))
    return need.withColumn("required", F.lit(True)).unionByName(more.withColumn("required", F.lit(False)))


@_query(
    """WITH p AS (SELECT conv_id, list(struct_pack(turn := turn, role := role, h := md5(text)) ORDER BY turn) AS m, count(*) AS n, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id)
    SELECT conv_id, n, n_roles, array_to_string(list_transform(m, lambda x: x.role || ':' || x.h), ',') AS messages FROM p"""
)
def chat_messages(spark, d):
    """A conversation's messages in order, as role and text hash."""
    rows = I.table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.count_distinct("role").alias("n_roles"), F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("h")))).alias("m")
    )
    return rows.select("conv_id", "n", "n_roles", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["h"])), ",").alias("messages"))
