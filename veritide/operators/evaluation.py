"""Whole evaluations: predictions against claims, paired comparisons with intervals, taxonomy slices."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import TAXONOMY, retrieval_metrics

#: Bootstrap draws of a paired comparison, and the least that a representation report takes.
SAMPLES = 5000

# Metrics that are compared in pairs.
COMPARED = ("recall_5", "mrr_10", "ndcg_10", "evidence_f1")


def evaluated(claims: DataFrame, predictions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10, 50)) -> DataFrame:
    """Per claim (query_id, label): retrieval metrics, label_correct (null without a gold label) and error categories.

    ``predictions`` has (query_id, label, evidence_ids); a claim without one has an empty list.
    """
    ranked = predictions.select("query_id", F.posexplode("evidence_ids").alias("at", "doc_id")).withColumn("rank", F.col("at") + 1)
    per = retrieval_metrics(claims, ranked, gold, ks)
    labels = claims.select("query_id", F.col("label").alias("gold_label")).join(predictions.select("query_id", F.col("label").alias("predicted_label")), "query_id", "left")
    correct = F.when(F.col("gold_label").isNotNull(), F.coalesce(F.col("predicted_label") == F.col("gold_label"), F.lit(False)).cast("double"))
    has_gold = gold.select("query_id").distinct().withColumn("has_gold", F.lit(True))
    rows = per.join(labels.withColumn("label_correct", correct), "query_id").join(has_gold, "query_id", "left")
    missed = F.col("has_gold").isNotNull() & (F.col("evidence_recall") == 0)
    found = F.when(missed, "retrieval_miss").when(F.col("evidence_f1") < 1, "partial_or_over_retrieval")
    wrong = F.when(F.col("label_correct") == 0, "classification_error")
    return rows.withColumn("categories", F.array_compact(F.array(found, wrong))).drop("has_gold")


def aggregate(per: DataFrame) -> dict[str, Any]:
    """Means over all claims; accuracy over labelled ones, and its harmonic mean with evidence F1."""
    names = [c for c, t in per.dtypes if t == "double" and c != "label_correct"]
    out = per.agg(F.count("*").alias("claim_count"), F.count("label_correct").alias("labelled_claim_count"), F.avg("label_correct").alias("claim_accuracy"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names]).first().asDict()
    if out["labelled_claim_count"]:
        f1, acc = out["evidence_f1"], out["claim_accuracy"]
        out["harmonic_mean"] = 2 * f1 * acc / (f1 + acc) if f1 + acc else 0.0
    else:
        del out["labelled_claim_count"], out["claim_accuracy"]
    return out


def error_rows(per: DataFrame) -> DataFrame:
    return per.where(F.size("categories") > 0)


def paired(base: DataFrame, other: DataFrame, metrics: tuple[str, ...] = COMPARED) -> DataFrame:
    """(query_id, metric, difference) of two per-claim tables; sets of claims that differ are an error when rows are read."""
    kind = lambda c: F.struct(F.lit(c).alias("metric"), (F.coalesce(f"o.{c}", wrong) - F.coalesce(f"b.{c}", wrong)).alias("difference"))
    wrong = F.raise_error(F.lit("both sides need the same claims")).cast("double")
    joined = base.alias("b").join(other.alias("o"), F.col("b.query_id") == F.col("o.query_id"), "full_outer")
    return joined.select(F.coalesce("b.query_id", "o.query_id").alias("query_id"), F.inline(F.array(*[kind(c) for c in metrics])))


def compared(base: DataFrame, other: DataFrame, *, metrics: tuple[str, ...] = COMPARED, samples: int = SAMPLES, seed: int = 17) -> DataFrame:
    """(metric, mean_difference, ci_lower, ci_upper): 95 % of ``samples`` paired bootstrap means, one task a metric of one number a claim."""

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        d = part.sort_values("query_id")["difference"].to_numpy(float)
        rng = np.random.default_rng(seed)
        means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(samples)])
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"metric": [part["metric"].iloc[0]], "mean_difference": [d.mean()], "ci_lower": [low], "ci_upper": [high]})

    return paired(base, other, metrics).groupBy("metric").applyInPandas(draw, "metric string, mean_difference double, ci_lower double, ci_upper double")


def slices(base: DataFrame, other: DataFrame, tags: DataFrame, *, metrics: tuple[str, ...] = COMPARED) -> DataFrame:
    """(tag, query_count, base_, candidate_ and delta_ means) for every tag of the taxonomy; means of an empty slice are null."""
    every = base.sparkSession.createDataFrame([(t,) for t in TAXONOMY], "tag string")
    side = lambda df, n: df.select("query_id", *[F.col(c).alias(f"{n}_{c}") for c in metrics])
    rows = tags.select("query_id", "tag").distinct().join(side(base, "base"), "query_id").join(side(other, "candidate"), "query_id")
    aggs = [F.avg(f"{n}_{c}").alias(f"{n}_{c}") for n in ("base", "candidate") for c in metrics]
    aggs += [F.avg(F.col(f"candidate_{c}") - F.col(f"base_{c}")).alias(f"delta_{c}") for c in metrics]
    return every.join(rows.groupBy("tag").agg(F.count("*").alias("query_count"), *aggs), "tag", "left").fillna(0, ["query_count"])


def representation_report(claims: DataFrame, gold: DataFrame, base: DataFrame, candidate: DataFrame, tags: DataFrame, *, samples: int = SAMPLES) -> dict[str, Any]:
    """Both systems' means, paired intervals and slices; the sets of claims must be equal and the draws 5,000 or more."""
    if samples < SAMPLES:
        raise ValueError(f"at least {SAMPLES} samples")
    ids = claims.select("query_id")
    for p in (base, candidate):
        own = p.select("query_id")
        if not own.exceptAll(ids).isEmpty() or not ids.exceptAll(own).isEmpty():
            raise ValueError("predictions and claims must have the same ids")
    b, c = evaluated(claims, base, gold), evaluated(claims, candidate, gold)
    return {
        "baseline": aggregate(b), "candidate": aggregate(c),
        "paired_bootstrap": {r["metric"]: {k: r[k] for k in ("mean_difference", "ci_lower", "ci_upper")} for r in compared(b, c, samples=samples).collect()},
        "taxonomy": {r["tag"]: r.asDict() for r in slices(b, c, tags).collect()},
    }


def pareto(profiles: DataFrame, *, quality: str = "evidence_f1") -> DataFrame:
    """``profiles`` (name, comparability_group, quality, p95_ms, memory_bytes) with pareto_status and the sorted names of dominators."""
    needed = {"name", "comparability_group", quality, "p95_ms", "memory_bytes"}
    if missing := sorted(needed - set(profiles.columns)):
        raise ValueError(f"missing fields: {missing}")
    a, b = profiles.alias("a"), profiles.alias("b")
    as_good = (F.col(f"b.{quality}") >= F.col(f"a.{quality}")) & (F.col("b.p95_ms") <= F.col("a.p95_ms")) & (F.col("b.memory_bytes") <= F.col("a.memory_bytes"))
    better = (F.col(f"b.{quality}") > F.col(f"a.{quality}")) | (F.col("b.p95_ms") < F.col("a.p95_ms")) | (F.col("b.memory_bytes") < F.col("a.memory_bytes"))
    same_group = F.col("a.comparability_group") == F.col("b.comparability_group")
    by = a.join(b, same_group & as_good & better).groupBy("a.name", "a.comparability_group").agg(F.array_sort(F.collect_list("b.name")).alias("dominated_by"))
    out = profiles.join(by, ["name", "comparability_group"], "left").withColumn("dominated_by", F.coalesce("dominated_by", F.array().cast("array<string>")))
    return out.withColumn("pareto_status", F.when(F.size("dominated_by") > 0, "dominated").otherwise("frontier"))
