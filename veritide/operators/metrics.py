"""Retrieval, verification, calibration and frontier metrics as aggregations."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verdict labels, and the tags of the query taxonomy in their order.
VERDICTS = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")
TAXONOMY = (
    "spelling", "entity", "year_or_numeric", "geographic", "lexical_mismatch", "semantic_paraphrase", "multi_evidence", "unanswerable",
)


def retrieval_metrics(claims: DataFrame, ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 50)) -> DataFrame:
    """Per claim: recall and hit at each k, mrr@10, ndcg@10 and evidence precision, recall, f1.

    ``ranked`` has (query_id, doc_id, rank) with ranks from 1; a repeated id counts in the length
    and in the gain, but once as found. Claims without a ranking or gold get zeros.
    """
    g = gold.select("query_id", "doc_id").distinct().withColumn("is_gold", F.lit(1))
    rows = ranked.select("query_id", "doc_id", "rank").join(g, ["query_id", "doc_id"], "left")
    hit = F.col("is_gold").isNotNull()
    found = lambda cond: F.count_distinct(F.when(cond & hit, F.col("doc_id")))
    per = rows.groupBy("query_id").agg(
        F.count("*").alias("n_pred"),
        found(F.lit(True)).alias("n_hit"),
        *[found(F.col("rank") <= k).alias(f"hit_{k}") for k in ks],
        F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    size = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    out = claims.select("query_id").join(per, "query_id", "left").join(size, "query_id", "left")
    n_gold = F.coalesce("n_gold", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n_gold, F.lit(10)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    share = lambda top, bottom: zero(F.try_divide(F.col(top).cast("double"), F.nullif(F.col(bottom), F.lit(0))))
    out = out.select(
        "query_id",
        *[share(f"hit_{k}", "n_gold").alias(f"recall_{k}") for k in ks],
        *[F.when(F.col(f"hit_{k}") > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks],
        zero(1 / F.col("first")).alias("mrr_10"),
        F.when(n_gold > 0, zero(F.col("dcg")) / ideal).otherwise(F.lit(0.0)).alias("ndcg_10"),
        share("n_hit", "n_pred").alias("evidence_precision"),
        share("n_hit", "n_gold").alias("evidence_recall"),
    )
    p, r = F.col("evidence_precision"), F.col("evidence_recall")
    return out.withColumn("evidence_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over all claims (of each group)."""
    names = [c for c, t in metrics.dtypes if t == "double" and c not in (by or [])]
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n_claims"), *[F.avg(c).alias(c) for c in names])


def error_categories(metrics: DataFrame, gold: DataFrame) -> DataFrame:
    """retrieval_miss (gold, none found) or partial_or_over_retrieval (f1 below 1)."""
    size = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    rows = metrics.join(size, "query_id", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    kind = (
        F.when((F.col("n_gold") > 0) & (F.col("evidence_recall") == 0), "retrieval_miss")
        .when(F.col("evidence_f1") < 1, "partial_or_over_retrieval")
        .otherwise("none")
    )
    return rows.select("query_id", kind.alias("category"))


def verification_scores(rows: DataFrame, labels: tuple[str, ...] = VERDICTS) -> DataFrame:
    """(gold, predicted, confidence) to accuracy, Brier score of correctness, and per label precision, recall, f1; macro f1."""
    agg = [F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy")]
    right = (F.col("gold") == F.col("predicted")).cast("double")
    agg.append(F.avg((F.col("confidence") - right) ** 2).alias("brier"))
    for x in labels:
        agg += [
            F.sum(((F.col("gold") == x) & (F.col("predicted") == x)).cast("int")).alias(f"tp_{x}"),
            F.sum((F.col("predicted") == x).cast("int")).alias(f"pred_{x}"),
            F.sum((F.col("gold") == x).cast("int")).alias(f"gold_{x}"),
        ]
    one = rows.agg(*agg)
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    each = []
    for x in labels:
        p, r = div(f"tp_{x}", f"pred_{x}"), div(f"tp_{x}", f"gold_{x}")
        f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        each.append(F.struct(F.lit(x).alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.col(f"gold_{x}").alias("n_gold")))
    macro_f1 = sum((e["f1"] for e in each), F.lit(0.0)) / len(labels)
    return one.select("accuracy", "brier", macro_f1.alias("macro_f1"), F.inline(F.array(*each)))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins [lo, hi) of confidence, the last closed: count, mean confidence, accuracy, weighted gap."""
    spark = rows.sparkSession
    edges = np.linspace(0, 1, bins + 1)
    table = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(bins)], "bin int, lo double, hi double")
    c = F.col("confidence")
    inside = (c >= F.col("lo")) & ((c < F.col("hi")) | ((F.col("bin") == bins - 1) & (c <= F.col("hi"))))
    hit = (F.col("gold") == F.col("predicted")).cast("double")
    placed = rows.join(F.broadcast(table), inside).groupBy("bin").agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg(hit).alias("accuracy"))
    total = F.sum("n").over(Window.partitionBy())
    return placed.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / total)


def temperature_grid(rows: DataFrame, *, low: float = 0.05, high: float = 10.0, steps: int = 401) -> DataFrame:
    """(logits, label index) to (temperature, nll) over a geometric grid; the grid is a constant of ``steps`` numbers."""
    grid = [float(t) for t in np.geomspace(low, high, steps)]
    shifted = F.transform("logits", lambda x: x - F.array_max("logits"))

    def loss(t: Column) -> Column:
        total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + F.exp(x / t))
        p = F.exp(F.get(shifted, F.col("label")) / t) / total
        return -F.log(F.greatest(p, F.lit(1e-15)))

    each = F.transform(F.array(*[F.lit(t) for t in grid]), lambda t: F.struct(t.alias("temperature"), loss(t).alias("loss")))
    return rows.select(F.inline(each)).groupBy("temperature").agg(F.avg("loss").alias("nll"))


def selective_risk(rows: DataFrame, *, id_col: str = "query_id") -> DataFrame:
    """Coverage, risk and accuracy as ever less confident rows are answered; ties by id."""
    w = Window.orderBy(F.desc("confidence"), id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count("*").over(w)
    wrong = F.sum((F.col("gold") != F.col("predicted")).cast("int")).over(w)
    total = F.count("*").over(Window.partitionBy())
    return rows.select(id_col, (n / total).alias("coverage"), (wrong / n).alias("risk"), (1 - wrong / n).alias("accuracy"), F.col("confidence").alias("threshold"))


def citation_scores(gold: DataFrame, predicted: DataFrame, claims: DataFrame) -> DataFrame:
    """Micro precision, recall and f1 of (query_id, doc_id) citations, and the share of claims whose gold is all cited."""
    g = gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(1))
    p = predicted.select("query_id", "doc_id").distinct().withColumn("p", F.lit(1))
    both = g.join(p, ["query_id", "doc_id"], "full_outer")
    per = both.groupBy("query_id").agg(
        F.count("g").alias("g"), F.count("p").alias("p"), F.sum((F.col("g").isNotNull() & F.col("p").isNotNull()).cast("int")).alias("both")
    )
    rows = claims.select("query_id").join(per, "query_id", "left").fillna(0)
    done = ((F.col("g") > 0) & (F.col("both") == F.col("g"))).cast("double")
    one = rows.agg(F.sum("g").alias("g"), F.sum("p").alias("p"), F.sum("both").alias("both"), F.avg(done).alias("completeness"))
    prec = F.coalesce(F.try_divide(F.col("both").cast("double"), F.nullif(F.col("p"), F.lit(0))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("both").cast("double"), F.nullif(F.col("g"), F.lit(0))), F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return one.select(prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "completeness")


def _as_good(points: DataFrame, group: str, ranks: list[str], last: Column) -> DataFrame:
    """Adds ``as_good``: how many rows (sum of ``copies``) of a point's group have no larger rank and no larger ``last``.

    Ranks count from 1. Counts below a rank are sums over aligned runs of 1, 2, 4 and so on ranks, so
    that each point is counted in a logarithm of runs a rank, and asks as many; within a combination of
    runs a running sum along ``last`` answers.
    """
    held, asks = points.withColumn("asks", F.lit(0)), points.withColumn("asks", F.lit(1))
    levels = F.sequence(F.lit(0), F.length(F.bin("most")) - 1)

    def shifted(value: Column, by: Column) -> Column:
        return F.call_function("shiftright", value, by)

    def runs(at) -> Column:
        return F.transform(levels, lambda e: F.struct(e.alias("e"), at(e).alias("run")))

    for k, r in enumerate(ranks):
        rank = F.col(r)
        # The ranks up to this one are one run for each of its bits.
        bit = lambda x: shifted(rank, x["e"]).bitwiseAND(F.lit(1)) == 1  # noqa: B023, E731
        held = held.withColumn("most", F.col(f"{r}_most")).withColumn(f"run{k}", F.explode(runs(lambda e: shifted(rank - 1, e))))  # noqa: B023
        asks = asks.withColumn("most", F.col(f"{r}_most")).withColumn(f"run{k}", F.explode(F.filter(runs(lambda e: shifted(rank, e) - 1), bit)))  # noqa: B023
    w = Window.partitionBy(group, *[f"run{k}" for k in range(len(ranks))]).orderBy(last).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = held.unionByName(asks).withColumn("n", F.sum(F.when(F.col("asks") == 0, F.col("copies")).otherwise(0)).over(w))
    return both.where("asks = 1").groupBy("point").agg(F.sum("n").alias("as_good"))


def pareto_front(rows: DataFrame, *, group: str, name: str, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Rows of each group that no other row equals or beats everywhere and beats somewhere; adds ``dominated_by`` (a count).

    Equal rows are one point. A point's dominators are the rows as good everywhere, less its equals;
    they are counted (see :func:`_as_good`) in n log n rows an objective beside the last, never paired.
    A null group or objective dominates nothing and is not dominated.
    """
    goals = [(c, True) for c in maximise] + [(c, False) for c in minimise]
    columns = [c for c, _ in goals]
    keys = ["of", *[f"g{k}" for k in range(len(goals))]]
    known = rows.select(name, *[F.col(c).alias(k) for k, c in zip(keys, [group, *columns], strict=True)])
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    points = known.groupBy(*keys).agg(F.count("*").alias("copies"))
    ranks = []
    for k, (_, larger) in enumerate(goals[:-1]):
        order = F.desc(f"g{k}") if larger else F.asc(f"g{k}")
        place = points.select("of", f"g{k}").distinct().withColumn(f"rank{k}", F.row_number().over(Window.partitionBy("of").orderBy(order)).cast("long"))
        place = place.withColumn(f"rank{k}_most", F.count("*").over(Window.partitionBy("of")))
        points = points.join(place, ["of", f"g{k}"])
        ranks.append(f"rank{k}")
    last = len(goals) - 1
    points = points.withColumn("most", F.lit(0).cast("long")).withColumn("point", F.struct(*keys, "copies"))
    found = _as_good(points, "of", ranks, F.desc(f"g{last}") if goals[-1][1] else F.asc(f"g{last}"))
    counts = found.select("point.*", "as_good").select(*keys, (F.col("as_good") - F.col("copies")).alias("more"))
    beaten = known.join(counts, keys).groupBy(name).agg(F.sum("more").alias("dominated_by"))
    out = rows.join(beaten, name, "left").fillna(0, ["dominated_by"])
    return out.withColumn("on_front", F.col("dominated_by") == 0)


def total_variation(left: DataFrame, right: DataFrame, *, key: str, count: str = "n") -> DataFrame:
    """Half the summed difference of two normalised distributions."""
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    l = left.select(key, share(count).alias("p"))  # noqa: E741
    r = right.select(key, share(count).alias("q"))
    d = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return l.join(r, key, "full_outer").agg((F.sum(d) / 2).alias("total_variation"))


def nearest_rank(rows: DataFrame, q: float, *, by: str, value: str) -> DataFrame:
    """The value at place int(q n) (from 0, at most n - 1) of each group, by exact counting rather than by a collected list."""
    w = Window.partitionBy(by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(by))
    at = F.least(F.floor(F.lit(q) * n), n - 1) + 1
    return rows.select(by, value, F.row_number().over(w).alias("nth"), at.alias("at")).where("nth = at").select(by, value)


def paired_bootstrap(rows: DataFrame, *, by: str, samples: int = 2000, confidence: float = 0.95, seed: int = 17) -> DataFrame:
    """(by, id, base, candidate) to mean difference, interval and two-sided p, by resampling ids with NumPy's generator.

    One group a metric; a group holds one number a claim.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        d = (pdf["candidate"] - pdf["base"]).to_numpy()
        rng = np.random.default_rng(seed)
        means = d[rng.integers(0, len(d), size=(samples, len(d)))].mean(axis=1)
        tail = (1 - confidence) / 2
        low, high = np.quantile(means, [tail, 1 - tail])
        p = min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean()))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean_difference": [d.mean()], "ci_lower": [low], "ci_upper": [high], "p_value": [p]})

    return rows.select(by, "id", "base", "candidate").groupBy(by).applyInPandas(
        one, f"{by} string, mean_difference double, ci_lower double, ci_upper double, p_value double"
    )


def hash_bootstrap(rows: DataFrame, *, samples: int = 200, seed: int = 17) -> DataFrame:
    """(id, difference) to mean difference and interval, resampled by integer arithmetic that any engine repeats."""
    w = Window.orderBy("id")
    n = rows.count()
    placed = rows.select((F.row_number().over(w) - 1).alias("i"), "difference")
    draws = rows.sparkSession.range(samples * n).select((F.col("id") / n).cast("long").alias("s"), (F.col("id") % n).alias("p"))
    raw = ((7919 * F.col("s") + 104729 * F.col("p") + seed) * 40503) % (1 << 32)
    draws = draws.select("s", (F.floor(raw / 65536) % n).alias("i"))
    means = draws.join(placed, "i").groupBy("s").agg(F.avg("difference").alias("m"))
    return means.agg(
        F.avg("m").alias("mean_difference"), F.percentile("m", F.lit(0.025)).alias("ci_lower"), F.percentile("m", F.lit(0.975)).alias("ci_upper")
    )


