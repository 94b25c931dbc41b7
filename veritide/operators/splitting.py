"""Public corpora of annotated claims: corpus, grouped splits, their checks, audits, seals and pilots.

``claims`` has (claim_id, text, label), ``annotations`` (claim_id, evidence_id, label, text), and a
split (claim_id, split). Only component sizes and counts come to the driver.
"""

from __future__ import annotations

import random
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..files import ordered_id_sha256, write_json
from ..functions import text as T
from .dedup import components, near_duplicate_links, near_duplicate_pairs, stored

# Seed and shares of the split, and the labels that decide a claim.
SEED = 20260825
SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
DECISIVE = ("SUPPORTS", "REFUTES")


def public_corpus(annotations: DataFrame) -> DataFrame:
    """(evidence_id, text) once each; an id with several texts is an error when rows are read."""
    per = annotations.groupBy("evidence_id").agg(F.min("text").alias("text"), F.max("text").alias("other"))
    wrong = F.raise_error(F.concat(F.lit("evidence id has inconsistent text: "), F.col("evidence_id"))).cast("string")
    return per.select("evidence_id", F.when(F.col("text") == F.col("other"), F.col("text")).otherwise(wrong).alias("text"))


def _near(rows: DataFrame, percent: int) -> DataFrame:
    return near_duplicate_pairs(rows, percent=percent, id_col="id", text_col="text")


def _near_links(rows: DataFrame, percent: int) -> DataFrame:
    return near_duplicate_links(rows, percent=percent, id_col="id", text_col="text")


def claim_edges(claims: DataFrame, annotations: DataFrame, *, percent: int = 90) -> DataFrame:
    """(left_id, right_id) that join the claims that must stay together.

    Five kinds: equal normalised claims, a shared evidence id, equal normalised evidence texts, near
    duplicate claims, near duplicate evidence. Claims of one key are linked with the key's smallest
    claim, so a key of n claims has n - 1 edges; near duplicates are linked, too, not paired.
    """

    def starred(keyed: DataFrame) -> DataFrame:
        first = keyed.groupBy("key").agg(F.min("claim_id").alias("left_id"))
        return keyed.join(first, "key").select("left_id", F.col("claim_id").alias("right_id")).where("left_id <> right_id")

    near_evidence = _near_links(annotations.groupBy(F.col("evidence_id").alias("id")).agg(F.min("text").alias("text")), percent)
    owner = annotations.groupBy("evidence_id").agg(F.min("claim_id").alias("claim_id"))
    of = lambda side: owner.select(F.col("evidence_id").alias(f"{side}_id"), F.col("claim_id").alias(f"{side}_claim"))
    met = near_evidence.join(of("left"), "left_id").join(of("right"), "right_id")
    # A whole text is a long key; its SHA-256 is as good.
    key = F.sha2(T.normalised(F.col("text")), 256).alias("key")
    out = starred(claims.select("claim_id", key))
    out = out.unionByName(starred(annotations.select("claim_id", F.col("evidence_id").alias("key")).distinct()))
    out = out.unionByName(starred(annotations.select("claim_id", key).distinct()))
    out = out.unionByName(_near_links(claims.select(F.col("claim_id").alias("id"), "text"), percent))
    out = out.unionByName(met.select(F.col("left_claim").alias("left_id"), F.col("right_claim").alias("right_id")).where("left_id <> right_id"))
    return out.distinct()


def assigned(sizes: list[tuple[Any, int]], *, seed: int = SEED) -> dict[Any, str]:
    """Components to splits: shuffled, then largest first, each to the split that it leaves least filled beyond its target."""
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    order.sort(key=lambda x: -x[1])
    total = sum(n for _, n in sizes)
    target = {s: max(total * share, 1.0) for s, share in SHARES.items()}
    goal = {s: total * share for s, share in SHARES.items()}
    filled, out = dict.fromkeys(SHARES, 0), {}
    for component, n in order:
        s = min(SHARES, key=lambda s: ((filled[s] + n - goal[s]) / target[s], filled[s] / target[s], s))
        out[component] = s
        filled[s] += n
    return out


def grouped_split(claims: DataFrame, annotations: DataFrame, *, seed: int = SEED, percent: int = 90) -> DataFrame:
    """(claim_id, component, split): claims that any edge links share a split.

    Components of one size are dealt alike, so the driver gets one row a component of two claims or
    more; single claims are dealt by the same rule from their count. Rows go back by a broadcast of those components.
    """
    found = stored(components(claims.select(F.col("claim_id").alias("id")), claim_edges(claims, annotations, percent=percent)))
    sizes = [(r[0], r[1]) for r in found.groupBy("component").count().toLocalIterator()]
    spark = claims.sparkSession
    dealt = assigned(sizes, seed=seed)
    kind = found.schema["component"].dataType.simpleString()
    table = spark.createDataFrame(list(dealt.items()), f"component {kind}, split string")
    return found.join(table, "component").select(F.col("id").alias("claim_id"), "component", "split")


def straddling(keyed: DataFrame) -> DataFrame:
    """(key, splits) of (key, split) rows whose key has several splits."""
    per = keyed.distinct().groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return per.where(F.size("splits") > 1)


def _keys(claims: DataFrame, annotations: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    a = annotations.join(split.select("claim_id", "split"), "claim_id")
    c = claims.join(split.select("claim_id", "split"), "claim_id")
    decisive = a.where(F.upper("label").isin(*DECISIVE))
    by_id = lambda df: df.select(F.col("evidence_id").alias("key"), "split")
    by_text = lambda df: df.select(T.normalised(F.col("text")).alias("key"), "split")
    return {
        "shared_evidence_id_cross_split": by_id(a),
        "normalised_claim_duplicate_cross_split": by_text(c),
        "normalised_evidence_text_cross_split": by_text(a),
        "shared_decisive_evidence_id_cross_split": by_id(decisive),
        "normalised_decisive_evidence_text_cross_split": by_text(decisive),
    }


def check_split(claims: DataFrame, annotations: DataFrame, split: DataFrame) -> None:
    """Every claim in one split, no evidence id and no normalised claim in several; else an error."""
    n = claims.select("claim_id").distinct().count()
    rows, ids = split.agg(F.count("*"), F.count_distinct("claim_id")).first()
    if not rows == ids == n or not claims.join(split, "claim_id", "left_anti").isEmpty():
        raise ValueError("the split must hold every claim once")
    keys = _keys(claims, annotations, split)
    for name in ("shared_evidence_id_cross_split", "normalised_claim_duplicate_cross_split"):
        if not straddling(keys[name]).isEmpty():
            raise ValueError(name)


def _near_straddling(rows: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Near duplicate pairs of (id, text) whose (id, splits) owners name several splits together."""
    side = lambda s: owners.select(F.col("id").alias(f"{s}_id"), F.col("splits").alias(f"{s}_splits"))
    met = _near(rows, percent).join(side("left"), "left_id").join(side("right"), "right_id")
    return met.where(F.size(F.array_union("left_splits", "right_splits")) > 1)


def audit(claims: DataFrame, annotations: DataFrame, split: DataFrame, *, percent: int = 90, examples: int = 10) -> dict[str, Any]:
    """Eight leakage counters, up to ten examples of near duplicates, and two statuses: of all documents, and of decisive ones."""
    keys = _keys(claims, annotations, split)
    out: dict[str, Any] = {name: straddling(k).count() for name, k in keys.items()}
    owners = lambda df, key: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    a = annotations.join(split.select("claim_id", "split"), "claim_id")
    texts = annotations.groupBy(F.col("evidence_id").alias("id")).agg(F.min("text").alias("text"))
    near = {
        "near_duplicate_claim_pairs_cross_split": (claims.select(F.col("claim_id").alias("id"), "text"), owners(split, "claim_id")),
        "near_duplicate_evidence_pairs_cross_split": (texts, owners(a, "evidence_id")),
        "near_duplicate_decisive_evidence_pairs_cross_split": (texts, owners(a.where(F.upper("label").isin(*DECISIVE)), "evidence_id")),
    }
    for name, (rows, own) in near.items():
        met = stored(_near_straddling(rows, own, percent))
        out[name] = met.count()
        if "decisive" not in name:
            out[name.replace("pairs_cross_split", "examples")] = [r.asDict() for r in met.orderBy("left_id", "right_id").limit(examples).collect()]
    decisive = [n for n in out if "decisive" in n]
    plain = [n for n in out if n.endswith("cross_split") and n not in decisive]
    out["status"] = "passed" if not any(out[n] for n in plain) else "failed"
    out["supervised_relevance_status"] = "passed" if not any(out[n] for n in decisive) else "failed"
    return out


def export_splits(claims: DataFrame, split: DataFrame, folder: str, *, sealed: str = "test") -> dict[str, Any]:
    """Write each split's claims as JSON lines, but of the sealed one only its count and the hash of its ids."""
    out: dict[str, Any] = {}
    for r in split.groupBy("split").count().orderBy("split").collect():
        mine = split.where(F.col("split") == r["split"]).select("claim_id")
        seal = {"count": r["count"], "ids_sha256": ordered_id_sha256(mine, "claim_id")}
        out[r["split"]] = seal | {"sealed": r["split"] == sealed}
        if r["split"] != sealed:
            claims.join(mine, "claim_id", "left_semi").write.mode("overwrite").json(f"{folder}/{r['split']}")
    write_json(Path(folder.removeprefix("file://")) / "seal.json", out)
    return out


def pilot_ids(ids: list[str], *, size: int, seed: int) -> list[str]:
    """``size`` of the decisive claims, by a seeded shuffle of their sorted ids."""
    order = sorted(map(str, ids))
    if not 0 < size <= len(order):
        raise ValueError("pilot size must be within the decisive claims")
    random.Random(seed).shuffle(order)
    return sorted(order[:size])


def gold_of(annotations: DataFrame) -> DataFrame:
    """(query_id, doc_id) of decisive annotations."""
    return annotations.where(F.upper("label").isin(*DECISIVE)).select(F.col("claim_id").alias("query_id"), F.col("evidence_id").alias("doc_id")).distinct()


def prepared_split(claims: DataFrame, gold: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """A split's claims that have gold."""
    mine = split.where(F.col("split") == name).select("claim_id")
    return claims.join(mine, "claim_id", "left_semi").join(gold.select(F.col("query_id").alias("claim_id")), "claim_id", "left_semi")


def prepare(claims: DataFrame, annotations: DataFrame, folder: str, *, seed: int = SEED) -> dict[str, Any]:
    """Corpus, claims and split as JSON lines, checked and audited; the audit is written beside them."""
    corpus = public_corpus(annotations)
    split = stored(grouped_split(claims, annotations, seed=seed))
    check_split(claims, annotations, split)
    report = audit(claims, annotations, split)
    corpus.write.mode("overwrite").json(f"{folder}/evidence")
    gold = gold_of(annotations).groupBy(F.col("query_id").alias("claim_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("evidence_ids"))
    claims.join(gold, "claim_id", "left").write.mode("overwrite").json(f"{folder}/claims")
    split.select("claim_id", "split").write.mode("overwrite").json(f"{folder}/split")
    write_json(Path(folder.removeprefix("file://")) / "audit.json", report)
    return report


def bm25_benchmark(claims: DataFrame, annotations: DataFrame, split: DataFrame, name: str, *, k: int = 50) -> dict[str, float]:
    """BM25 over the public corpus for a split's decisive claims: macro metrics."""
    from . import metrics
    from .retrieval import BM25

    gold = gold_of(annotations)
    asked = prepared_split(claims, gold, split, name).select(F.col("claim_id").alias("query_id"), "text")
    ranked = BM25.fit(public_corpus(annotations), id_col="evidence_id").search(asked, k)
    mine = gold.join(asked, "query_id", "left_semi")
    return metrics.macro(metrics.retrieval_metrics(asked, ranked, mine)).first().asDict()
