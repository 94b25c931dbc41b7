"""Pairwise learning to rank, ridge gain models and cost-aware routing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pairs(rows: DataFrame, features: list[str]) -> DataFrame:
    """In-group pairs with the left row more relevant, as feature differences."""
    a, b = rows.alias("a"), rows.alias("b")
    cond = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.relevance") > F.col("b.relevance"))
    return a.join(b, cond).select(
        F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("better"), F.col("b.doc_id").alias("worse"),
        *[(F.col(f"a.{f}") - F.col(f"b.{f}")).alias(f) for f in features],
    )


def standardised(rows: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """z-scores with the population deviation; a constant feature is only centred."""
    one = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    stats = {f: (one[f"m_{f}"] or 0.0, one[f"s_{f}"] if (one[f"s_{f}"] or 0) >= 1e-12 else 1.0) for f in features}
    return rows.select(*[((F.col(c) - stats[c][0]) / stats[c][1]).alias(c) if c in stats else F.col(c) for c in rows.columns]), stats


class PairwiseRanker:
    """Linear ranker fitted by gradient descent on the logistic loss of all in-group pairs.

    Each epoch is one aggregation over the pairs; only a gradient comes to the driver.
    """

    def __init__(self, features: list[str], *, rate: float = 0.05, epochs: int = 30, l2: float = 1e-3):
        self.features, self.rate, self.epochs, self.l2 = list(features), rate, epochs, l2
        self.weights = np.zeros(len(self.features))
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, rows: DataFrame) -> PairwiseRanker:
        z, self.stats = standardised(rows, self.features)
        diff = pairs(z, self.features).persist()
        try:
            if not diff.limit(1).count():
                raise ValueError("no pair of rows with different relevance in a group")
            for epoch in range(self.epochs):
                margin = sum((F.col(f) * float(w) for f, w in zip(self.features, self.weights, strict=True)), F.lit(0.0))
                push = 1 / (1 + F.exp(F.least(F.greatest(margin, F.lit(-40.0)), F.lit(40.0))))
                got = diff.agg(*[F.avg(-push * F.col(f)).alias(f) for f in self.features]).first()
                gradient = np.array([got[f] for f in self.features]) + self.l2 * self.weights
                self.weights -= self.rate / np.sqrt(epoch + 1) * gradient
        finally:
            diff.unpersist()
        return self

    def score(self) -> Column:
        out = F.lit(0.0)
        for f, w in zip(self.features, self.weights, strict=True):
            mean, scale = self.stats.get(f, (0.0, 1.0))
            out = out + (F.coalesce(F.col(f), F.lit(0.0)) - mean) / scale * float(w)
        return out

    def to_dict(self) -> dict:
        return {"algorithm": "linear-pairwise", "features": self.features, "weights": self.weights.tolist(), "stats": {k: list(v) for k, v in self.stats.items()}}

    @classmethod
    def from_dict(cls, d: dict) -> PairwiseRanker:
        if d.get("algorithm") != "linear-pairwise":
            raise ValueError(f"another algorithm: {d.get('algorithm')}")
        out = cls(d["features"])
        out.weights, out.stats = np.array(d["weights"], float), {k: tuple(v) for k, v in d["stats"].items()}
        return out


def pairwise_accuracy(rows: DataFrame) -> DataFrame:
    """Share of in-group pairs of unequal relevance that scores order right; equal scores are wrong; none gives 0."""
    a, b = rows.alias("a"), rows.alias("b")
    cond = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.relevance") > F.col("b.relevance"))
    return a.join(b, cond).agg(
        F.count("*").alias("n_pairs"), F.coalesce(F.avg((F.col("a.score") > F.col("b.score")).cast("double")), F.lit(0.0)).alias("accuracy")
    )


def agreement_features(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Per claim: overlap of the first 1, 3 and 5 ids over k, and rank agreement, of two rankings."""
    return _agreement(left.select("query_id", "doc_id", "rank"), right.select("query_id", "doc_id", "rank"), "_".join(names))


class RidgeModel:
    """Least squares with an l2 penalty on standardised features, the intercept free; the Gram matrix is one aggregation."""

    def __init__(self, features: list[str], *, penalty: float = 1.0):
        self.features, self.penalty = list(features), penalty

    def fit(self, rows: DataFrame, target: str) -> RidgeModel:
        z, self.stats = standardised(rows.select(*self.features, target), self.features)
        names = ["__one", *self.features]
        z = z.withColumn("__one", F.lit(1.0))
        k = len(names)
        aggs = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col(target)) for a in names]
        got = list(z.agg(*aggs).first())
        gram = np.zeros((k, k))
        it = iter(got)
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = next(it) or 0.0
        right = np.array([next(it) or 0.0 for _ in range(k)])
        ridge = np.eye(k) * self.penalty
        ridge[0, 0] = 0
        self.weights = np.linalg.pinv(gram + ridge) @ right
        return self

    def score(self) -> Column:
        out = F.lit(float(self.weights[0]))
        for f, w in zip(self.features, self.weights[1:], strict=True):
            mean, scale = self.stats[f]
            out = out + (F.col(f) - mean) / scale * float(w)
        return out


def threshold_curve(rows: DataFrame) -> DataFrame:
    """(predicted, observed) gains: for each distinct prediction, the share of rows at or above it and the mean gain they bring."""
    total = rows.count()
    per = rows.groupBy("predicted").agg(F.count("*").alias("n"), F.sum("observed").alias("gain"))
    w = Window.orderBy(F.desc("predicted")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select("predicted", (F.sum("n").over(w) / total).alias("rate"), (F.sum("gain").over(w) / total).alias("mean_gain"))


def choose_threshold(rows: DataFrame, *, preserve: float = 0.8) -> tuple[float, float, float]:
    """(threshold, rate, mean gain): the lowest rate that keeps ``preserve`` of the full gain; routing nothing or all is considered too."""
    full = rows.agg(F.avg("observed")).first()[0] or 0.0
    need = max(0.0, preserve * full)
    best = threshold_curve(rows).where(F.col("mean_gain") + 1e-12 >= need).orderBy("rate", F.desc("mean_gain"), "predicted").first()
    if need <= 1e-12:
        return float("inf"), 0.0, 0.0
    return (best["predicted"], best["rate"], best["mean_gain"]) if best else (float("-inf"), 1.0, full)


def cross_fit(rows: DataFrame, features: list[str], *, folds: int = 5, penalty: float = 1.0, preserve: float = 0.8) -> DataFrame:
    """(id, fold, predicted, selected): each fold is judged by a model and a threshold of the others. An empty fold is an error."""
    placed = rows.withColumn("fold", T.stable_fold(F.col("id"), folds))
    out = None
    for k in range(folds):
        train, test = placed.where(F.col("fold") != k), placed.where(F.col("fold") == k)
        if not test.limit(1).count():
            raise ValueError(f"fold {k} is empty")
        model = RidgeModel(features, penalty=penalty).fit(train, "gain")
        limit, _, _ = choose_threshold(train.select(model.score().alias("predicted"), F.col("gain").alias("observed")), preserve=preserve)
        part = test.select("id", "fold", model.score().alias("predicted")).withColumn("selected", F.col("predicted") >= F.lit(limit))
        out = part if out is None else out.unionByName(part)
    return out


# -- persistence, selection and use of rankers ---------------------------------------------------


class TreeRanker:
    """Boosted regression trees on relevance (Spark ML), a pointwise ranker. It is not LambdaMART and never named so."""

    def __init__(self, features: list[str], *, trees: int = 50, depth: int = 4, rate: float = 0.1, seed: int = 7):
        self.features, self.trees, self.depth, self.rate, self.seed = list(features), trees, depth, rate, seed

    def _assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        return rows.withColumn("__x", array_to_vector(F.array(*values)))

    def fit(self, rows: DataFrame) -> TreeRanker:
        from pyspark.ml.regression import GBTRegressor

        learner = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="score", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed)
        self.model = learner.fit(self._assembled(rows).withColumn("__y", F.col("relevance").cast("double")))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._assembled(rows)).drop("__x")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        _session().createDataFrame([(["pointwise-trees", *self.features],)], "facts array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/facts")

    @classmethod
    def load(cls, path: str) -> TreeRanker:
        from pyspark.ml.regression import GBTRegressionModel

        kind, *features = _session().read.json(f"{path}/facts").first()["facts"]
        if kind != "pointwise-trees":
            raise ValueError(f"another algorithm: {kind}")
        out = cls(features)
        out.model = GBTRegressionModel.load(f"{path}/model")
        return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def save_ranker(ranker, path: str) -> None:
    """A linear ranker as a ``.json`` file, trees as a folder."""
    if isinstance(ranker, TreeRanker):
        ranker.save(path)
    else:
        from ..files import write_json

        write_json(path, ranker.to_dict())


def load_ranker(path: str):
    if str(path).endswith(".json"):
        from ..files import read_json

        return PairwiseRanker.from_dict(read_json(path))
    return TreeRanker.load(path)


def train_ranker(rows: DataFrame, features: list[str], *, kind: str = "auto"):
    """``linear``, ``trees``, or ``lambdamart``, which needs LightGBM and is never replaced under its name; ``auto`` takes the linear one without it."""
    if kind in ("auto", "lambdamart"):
        try:
            import lightgbm  # noqa: F401
        except ImportError as e:
            if kind == "lambdamart":
                raise RuntimeError("LightGBM is needed for LambdaMART") from e
            kind = "linear"
        else:
            return lambdamart(rows, features)
    if kind == "trees":
        return TreeRanker(features).fit(rows)
    if kind != "linear":
        raise ValueError(f"unknown ranker {kind}")
    return PairwiseRanker(features, epochs=300).fit(rows)


def lambdamart(rows: DataFrame, features: list[str], *, trees: int = 200, rate: float = 0.05, leaves: int = 31):
    """A LightGBM ranker fitted on the driver from rows sorted by group and id; for candidate tables that fit there."""
    from lightgbm import LGBMRanker

    data = rows.select("query_id", "doc_id", "relevance", *features).orderBy("query_id", "doc_id").toPandas()
    model = LGBMRanker(objective="lambdarank", metric="ndcg", n_estimators=trees, learning_rate=rate, num_leaves=leaves, deterministic=True, random_state=7)
    return model.fit(data[features], data["relevance"], group=data.groupby("query_id", sort=False).size().to_numpy())


def ranked_by(ranker, rows: DataFrame, *, top: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of candidate feature rows under a ranker; ties go to the smaller id."""
    scored = ranker.predict(rows) if isinstance(ranker, TreeRanker) else rows.withColumn("score", ranker.score())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    out = scored.select("query_id", "doc_id", "score").withColumn("rank", place)
    return out if top is None else out.where(F.col("rank") <= top)


def mined_rows(features: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows (relevance 2 for gold, else 0) of claims with a gold id among their candidates, and claim counts by kind."""
    g = gold.select("query_id", "doc_id").distinct()
    labelled = features.join(g.withColumn("relevance", F.lit(2)), ["query_id", "doc_id"], "left").fillna(0, ["relevance"])
    reached = labelled.where("relevance = 2").select("query_id").distinct()
    asked = features.select("query_id").distinct()
    kind = F.when(F.col("reached").isNotNull(), "supported").when(F.col("known").isNotNull(), "unsupported").otherwise("skipped")
    counts = (
        asked.join(reached.withColumn("reached", F.lit(1)), "query_id", "left")
        .join(g.select("query_id").distinct().withColumn("known", F.lit(1)), "query_id", "left")
        .groupBy(kind.alias("kind"))
        .agg(F.count("*").alias("n"))
    )
    return labelled.join(reached, "query_id", "left_semi"), counts


# -- routing features and evaluation ---------------------------------------------------------------


def route_features(bm25: DataFrame, dense: DataFrame, rrf: DataFrame) -> DataFrame:
    """The fourteen agreement features of three rankings a claim.

    Overlaps count distinct ids of the first 1, 3 and 5 places. Rank agreement sums
    2 / (left rank + right rank) over the left list (of a repeated right id its last place counts) and divides by the longer list.
    """
    lists = {n: df.select("query_id", "doc_id", "rank") for n, df in (("bm25", bm25), ("dense", dense), ("rrf", rrf))}
    out = None
    for a, b in (("bm25", "dense"), ("bm25", "rrf"), ("dense", "rrf")):
        one = _agreement(lists[a], lists[b], f"{a}_{b}")
        out = one if out is None else out.join(one, "query_id", "full_outer")
    marked = lists["rrf"]
    for n in ("bm25", "dense"):
        marked = marked.join(lists[n].select("query_id", "doc_id").distinct().withColumn(n, F.lit(1)), ["query_id", "doc_id"], "left")
    support = F.coalesce("bm25", F.lit(0)) + F.coalesce("dense", F.lit(0))
    share = lambda k: F.avg((support == k).cast("double"))
    support_rows = marked.groupBy("query_id").agg(share(2).alias("rrf_supported_by_both"), share(1).alias("rrf_supported_by_exactly_one"))
    return out.join(support_rows, "query_id", "full_outer").fillna(0.0)


def _agreement(left: DataFrame, right: DataFrame, tag: str) -> DataFrame:
    ks = (1, 3, 5)
    last = right.groupBy("query_id", "doc_id").agg(F.max("rank").alias("rr"), F.min("rank").alias("r_first"))
    met = left.join(last, ["query_id", "doc_id"])
    once = met.groupBy("query_id", "doc_id").agg(F.min("rank").alias("l_first"), F.min("r_first").alias("r_first"), F.sum(2 / (F.col("rank") + F.col("rr"))).alias("gain"))
    sizes = left.groupBy("query_id").agg(F.count("*").alias("nl")).join(right.groupBy("query_id").agg(F.count("*").alias("nr")), "query_id", "full_outer")
    both = once.groupBy("query_id").agg(
        *[(F.sum(((F.col("l_first") <= k) & (F.col("r_first") <= k)).cast("int")) / k).alias(f"{tag}_overlap_at_{k}") for k in ks], F.sum("gain").alias("gain")
    )
    joined = sizes.fillna(0).join(both, "query_id", "left").fillna(0.0)
    agreement = F.col("gain") / F.greatest("nl", "nr", F.lit(1))
    return joined.select("query_id", *[f"{tag}_overlap_at_{k}" for k in ks], agreement.alias(f"{tag}_rank_agreement"))


# Words that the text features count as negations.
ROUTE_NEGATIONS = "no not never none without neither nor".split()


def text_route_features(claims: DataFrame, *, dimensions: int = 128) -> DataFrame:
    """(query_id, five scalars, ``hashed``): log of the token count, shares of digit and negation tokens, brackets, question marks, and signed hashes of words and word pairs, normalised."""
    import hashlib

    import pyarrow as pa

    if dimensions <= 0:
        raise ValueError("dimensions must be positive")
    toks = T.alnum_tokens(F.col("text"))
    base = claims.select("query_id", "text", toks.alias("toks"))
    n = F.greatest(F.size("toks"), F.lit(1))
    count = lambda cond: F.size(F.filter("toks", cond)) / n
    chars = lambda of: (F.length("text") - F.length(F.translate("text", of, ""))).cast("double")
    scalars = base.select(
        "query_id",
        F.log1p(F.size("toks").cast("double")).alias("text_log_token_count"),
        count(lambda w: w.rlike("^[0-9]+$")).alias("text_digit_token_fraction"),
        count(lambda w: w.isin(*ROUTE_NEGATIONS)).alias("text_negation_fraction"),
        chars("[]").alias("text_bracket_count"),
        chars("?").alias("text_question_mark_count"),
    )
    after = F.slice("toks", 2, F.greatest(F.size("toks") - 1, F.lit(0)))
    pairs_of = F.transform(after, lambda w, i: F.concat(F.get("toks", i), F.lit("_"), w))
    terms = base.select("query_id", F.explode(F.concat("toks", pairs_of)).alias("term"))

    def places(batches):
        for batch in batches:
            values = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v % dimensions for v in values], pa.int32()), pa.array([1.0 if v & 1 else -1.0 for v in values])], names=["term", "col", "sign"]
            )

    hashed = terms.select("term").distinct().mapInArrow(places, "term string, col int, sign double")
    cells = terms.join(hashed, "term").groupBy("query_id", "col").agg(F.sum("sign").alias("v"))
    listed = cells.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)))
    joined = scalars.join(listed.select("query_id", dense.alias("hashed")), "query_id", "left")
    return joined.withColumn("hashed", F.coalesce("hashed", F.array_repeat(F.lit(0.0), dimensions)))


def by_system(rows: DataFrame, value: str, systems: list[str], *, order: str = "place") -> DataFrame:
    """(claim_id, a column a system) of (claim_id, system, value, order) rows: the last one of each counts."""
    last = rows.groupBy("claim_id", "system").agg(F.max_by(value, order).alias("v"))
    return last.groupBy("claim_id").pivot("system", systems).agg(F.first("v"))


def routed_metrics(rows: DataFrame, metrics: list[str], *, weak_seconds: float = 0.0, strong_seconds: float = 0.0) -> dict[str, float | None]:
    """Means of (claim_id, selected, weak_<m>, strong_<m>) rows: weak, strong, routed, the share of the full gain that routing keeps (null without one), and the expected seconds."""
    if not rows.where(" or ".join(f"weak_{m} is null or strong_{m} is null" for m in metrics)).isEmpty():
        raise ValueError("a claim lacks a system's metrics")
    pick = lambda m: F.when(F.col("selected"), F.col(f"strong_{m}")).otherwise(F.col(f"weak_{m}"))
    aggs = [F.avg(F.col("selected").cast("double")).alias("strong_call_rate"), F.count("*").alias("claim_count")]
    for m in metrics:
        aggs += [F.avg(f"weak_{m}").alias(f"weak_{m}"), F.avg(f"strong_{m}").alias(f"strong_{m}"), F.avg(pick(m)).alias(f"routed_{m}")]
    out = rows.agg(*aggs).first().asDict()
    for m in metrics:
        full = out[f"strong_{m}"] - out[f"weak_{m}"]
        out[f"preserved_{m}"] = (out[f"routed_{m}"] - out[f"weak_{m}"]) / full if full else None
    return out | {"calls_avoided_rate": 1 - out["strong_call_rate"], "seconds_per_query": weak_seconds + out["strong_call_rate"] * strong_seconds}
