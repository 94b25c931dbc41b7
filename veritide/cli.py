"""Commands: ``python -m veritide.cli COMMAND``. Each reads and writes files; a bad call, or an audit that fails, ends with 2."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .operators import contracts, evaluation, fusion, index, ranking, splitting
from .operators.protocols import HashEncoder
from .operators.retrieval import BM25
from .sources import records


def _spark(args: dict[str, Any]) -> SparkSession:
    return SparkSession.builder.master(args["master"]).config("spark.ui.enabled", "false").getOrCreate()


def _gold(claims: DataFrame) -> DataFrame:
    return claims.select(F.col("claim_id").alias("query_id"), F.explode("evidence_ids").alias("doc_id")).distinct()


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return records.read_evidence(spark, path).withColumnRenamed("evidence_id", "doc_id")


def _claims(spark: SparkSession, path: str) -> DataFrame:
    return records.read_claims(spark, path).withColumn("query_id", F.col("claim_id"))


def build_index(a: dict[str, Any]) -> dict[str, Any]:
    """BM25 and hash-encoded vectors of an evidence file."""
    files.required(a, "evidence", "output")
    spark, out = _spark(a), {}
    docs = _docs(spark, a["evidence"])
    if a["kind"] in ("bm25", "both"):
        built = BM25.fit(docs)
        index.save_bm25(built, f"{a['output']}/bm25")
        out["bm25"] = {"documents": built.n_docs, "mean_length": built.mean_length}
    if a["kind"] in ("dense", "both"):
        out["dense"] = index.DenseIndex.build(docs.withColumnRenamed("doc_id", "id"), HashEncoder(a["dimension"]), f"{a['output']}/dense")[1]
    return out


def benchmark_ann(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "index", "claims")
    spark = _spark(a)
    dense = index.DenseIndex.load(spark, f"{a['index']}/dense", HashEncoder(a["dimension"]))
    asked = dense.encoder.queries(records.read_claims(spark, a["claims"]).select(F.xxhash64("claim_id").alias("vec_id"), "text").withColumnRenamed("vec_id", "id"))
    vectors = dense.vectors.select(F.xxhash64("id").alias("vec_id"), "embedding")
    rows = index.ann_benchmark(vectors, asked.withColumnRenamed("id", "vec_id"), cells=a["cells"], probes=a["probes"])
    return {r["index"]: {"qps": r["qps"], "recall": r["recall"]} for r in rows.collect()}


def _features(spark: SparkSession, a: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    claims, docs = _claims(spark, a["claims"]), _docs(spark, a["evidence"])
    lists = records.read_rankings(spark, a["rankings"])
    route = lambda n: lists.where(F.col("source") == n).select("query_id", "doc_id", "score", "rank")
    wide = fusion.wide_candidates(route("bm25"), route("dense"), fusion.reciprocal_rank_fusion(lists, top=a["width"]))
    return fusion.candidate_features(wide, claims.select("query_id", "text"), docs), _gold(claims)


def mine_negatives(a: dict[str, Any]) -> dict[str, Any]:
    """Hard negatives, and training rows of claims with a reachable gold id."""
    files.required(a, "claims", "evidence", "rankings", "output")
    spark = _spark(a)
    features, gold = _features(spark, a)
    negatives = fusion.hard_negatives(records.read_rankings(spark, a["rankings"]), gold, limit=a["limit"])
    records.write_json_lines(negatives, f"{a['output']}/negatives")
    rows, kinds = ranking.mined_rows(features, gold)
    rows.write.mode("overwrite").parquet(f"{a['output']}/rows")
    return {"claims": {r["kind"]: r["n"] for r in kinds.collect()}, "rows": rows.count()}


def train_fusion(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "rows", "output")
    rows = _spark(a).read.parquet(a["rows"])
    names = a["features"].split(",") if a["features"] else list(fusion.FEATURES)
    model = ranking.train_ranker(rows, names, kind=a["ranker"])
    ranking.save_ranker(model, a["output"])
    return {"ranker": type(model).__name__, "accuracy": ranking.pairwise_accuracy(rows.withColumn("score", model.score())).first()["accuracy"] if hasattr(model, "score") else None}


def evaluate(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "claims", "predictions", "output")
    spark = _spark(a)
    claims = _claims(spark, a["claims"])
    gold = _gold(claims)
    per = evaluation.evaluated(claims, records.read_predictions(spark, a["predictions"]).withColumnRenamed("claim_id", "query_id"), gold)
    out = evaluation.aggregate(per)
    if a["baseline"]:
        base = evaluation.evaluated(claims, records.read_predictions(spark, a["baseline"]).withColumnRenamed("claim_id", "query_id"), gold)
        out["paired_bootstrap"] = {r["metric"]: r.asDict() for r in evaluation.compared(base, per, samples=a["samples"]).collect()}
    rows = ({**r.asDict(), "categories": list(r["categories"])} for r in evaluation.error_rows(per).toLocalIterator())
    files.write_run(a["output"], command="evaluate", arguments=a, metrics=out, started_at=a["started_at"], inputs={k: a[k] for k in ("claims", "predictions")}, errors=rows)
    return out


def prepare_public(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "claims", "output")
    claims, notes = records.read_annotated(_spark(a), a["claims"])
    return splitting.prepare(claims, notes, a["output"], seed=a["seed"])


def _prepared(a: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    files.required(a, "claims", "split")
    spark = _spark(a)
    claims, notes = records.read_annotated(spark, a["claims"])
    return claims, notes, spark.read.json(a["split"])


def benchmark_public(a: dict[str, Any]) -> dict[str, Any]:
    return splitting.bm25_benchmark(*_prepared(a), a["split_name"], k=a["top_k"])


def audit_public_split(a: dict[str, Any]) -> dict[str, Any]:
    claims, notes, split = _prepared(a)
    splitting.check_split(claims, notes, split)
    return splitting.audit(claims, notes, split)


def evaluate_representation(a: dict[str, Any]) -> dict[str, Any]:
    """Two systems under contracts that agree and a policy that allows the split."""
    files.required(a, "claims", "baseline", "candidate", "baseline_contract", "candidate_contract", "policy", "tags")
    spark = _spark(a)
    base, other = (contracts.RunContract.load(a[f"{n}_contract"]) for n in ("baseline", "candidate"))
    if wrong := contracts.mismatches(base, other):
        raise ValueError(f"contracts differ in {wrong}")
    if files.digest(a["claims"]) != other.claims_sha256:
        raise ValueError("the claims differ from the contract's")
    contracts.test_policy(a["policy"], split=other.split, system_id=other.system_id)
    claims = _claims(spark, a["claims"])
    runs = [records.read_prediction_variant(spark, a[n]).withColumnRenamed("claim_id", "query_id") for n in ("baseline", "candidate")]
    tags = spark.read.json(a["tags"]).select("query_id", "tag")
    return evaluation.representation_report(claims, _gold(claims), *runs, tags, samples=a["samples"])


def audit_stage_contract(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "training", "serving")
    return contracts.train_serve_audit(files.read_json(a["training"]), files.read_json(a["serving"]), limit=a["limit_tv"])


def build_pareto(a: dict[str, Any]) -> dict[str, Any]:
    files.required(a, "profiles")
    rows = _spark(a).createDataFrame([dict(r) for r in files.read_json(a["profiles"])])
    return {"profiles": [r.asDict() for r in evaluation.pareto(rows).orderBy("name").collect()]}


def serve(a: dict[str, Any]) -> dict[str, Any]:
    from .operators import serving

    files.required(a, "index", "evidence")
    spark = _spark(a)
    service = serving.Service(_docs(spark, a["evidence"]), index.load_bm25(spark, f"{a['index']}/bm25").search)
    serving.serve(service, a["port"]).serve_forever()
    return {}


COMMANDS: dict[str, tuple[Any, dict[str, Any]]] = {
    "index": (build_index, {"evidence": "", "output": "", "kind": "both", "dimension": 256}),
    "benchmark-ann": (benchmark_ann, {"index": "", "claims": "", "dimension": 256, "cells": 16, "probes": 8}),
    "mine-negatives": (mine_negatives, {"claims": "", "evidence": "", "rankings": "", "output": "", "limit": 20, "width": 100}),
    "train-fusion": (train_fusion, {"rows": "", "output": "", "ranker": "auto", "features": ""}),
    "evaluate": (evaluate, {"claims": "", "predictions": "", "baseline": "", "output": "", "samples": 2000}),
    "prepare-public": (prepare_public, {"claims": "", "output": "", "seed": splitting.SEED}),
    "benchmark-public": (benchmark_public, {"claims": "", "split": "", "split_name": "validation", "top_k": 50}),
    "audit-public-split": (audit_public_split, {"claims": "", "split": ""}),
    "evaluate-representation": (evaluate_representation, {n: "" for n in "claims baseline candidate baseline_contract candidate_contract policy tags".split()} | {"samples": 5000}),
    "audit-stage-contract": (audit_stage_contract, {"training": "", "serving": "", "limit_tv": 0.15}),
    "build-pareto": (build_pareto, {"profiles": ""}),
    "serve": (serve, {"index": "", "evidence": "", "port": 8080}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veritide")
    sub = top.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        p = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        p.add_argument("--config")
        p.add_argument("--master", default="local[*]")
        p.add_argument("--report", help="JSON file for the result")
        for option, default in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", default=default, type=type(default))
    return top


def main(argv: list[str] | None = None) -> int:
    """0, or 2 for a bad call, a failed audit, and errors of files, values, keys and running."""
    argv = sys.argv[1:] if argv is None else argv
    given = vars(parser().parse_args(argv))
    try:
        args = files.with_flags(files.load_config(given["config"], given["command"]), given, argv)
        args = files.expanded(args, ("evidence", "claims", "output", "index"))
        args["started_at"] = datetime.now(timezone.utc).isoformat()
        found = COMMANDS[given["command"]][0](args)
    except (OSError, RuntimeError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    if args["report"]:
        files.write_json(Path(args["report"]), found)
    print(json.dumps(found, indent=2, sort_keys=True, default=str))
    return 2 if found.get("status") == "failed" else 0


if __name__ == "__main__":
    raise SystemExit(main())
