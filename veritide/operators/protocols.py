"""What a user may plug in: encoders, rerankers and verifiers, with the ones that need no model."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fusion, verify
from .ann import hash_encoded

# Names of number types that adapters take.
DTYPES = {"auto": "auto", "bf16": "bfloat16", "bfloat16": "bfloat16", "fp16": "float16", "float16": "float16", "fp32": "float32", "float32": "float32"}


def dtype_name(name: str) -> str:
    if name not in DTYPES:
        raise ValueError(f"unknown number type {name}")
    return DTYPES[name]


# -- encoders -----------------------------------------------------------------------------------


class Encoder(ABC):
    """Texts to vectors: (id, text) to (id, embedding array<double>)."""

    name: str
    dimension: int

    @abstractmethod
    def documents(self, rows: DataFrame) -> DataFrame: ...

    def queries(self, rows: DataFrame) -> DataFrame:
        return self.documents(rows)


class HashEncoder(Encoder):
    """Signed hashes of tokens; needs no model."""

    def __init__(self, dimension: int = 256):
        self.name, self.dimension = f"hash-{dimension}", dimension

    def documents(self, rows: DataFrame) -> DataFrame:
        cells = hash_encoded(rows.select(F.col("id").alias("doc_id"), "text"), dimension=self.dimension)
        held = cells.groupBy(F.col("doc_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
        return rows.select("id").join(held.select("id", dense.alias("embedding")), "id", "left").withColumn(
            "embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), self.dimension))
        )


class FunctionEncoder(Encoder):
    """A function of a list of texts to a list of vectors, made once a worker by ``make``; batches go through Arrow."""

    def __init__(self, name: str, dimension: int, make: Callable[[], Callable[[list[str]], Any]], *, batch: int = 64):
        self.name, self.dimension, self.make, self.batch = name, dimension, make, batch

    def documents(self, rows: DataFrame) -> DataFrame:
        make, size = self.make, self.batch

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = make()
            for f in frames:
                for i in range(0, len(f), size):
                    part = f.iloc[i : i + size]
                    yield pd.DataFrame({"id": part["id"], "embedding": [list(map(float, v)) for v in encode(part["text"].fillna("").tolist())]})

        return rows.select("id", "text").mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>")


# -- rerankers ----------------------------------------------------------------------------------


class Reranker(ABC):
    """Orders (query_id, doc_id) candidates: (query_id, doc_id, score, rank)."""

    @abstractmethod
    def rerank(self, candidates: DataFrame, claims: DataFrame, docs: DataFrame, top: int) -> DataFrame: ...


class OverlapReranker(Reranker):
    def rerank(self, candidates: DataFrame, claims: DataFrame, docs: DataFrame, top: int) -> DataFrame:
        return fusion.deterministic_rerank(candidates, claims, docs, top=top)


class PairReranker(Reranker):
    """A scorer of (claim, text) pairs, made once a worker: a cross-encoder, or a client of a remote one. It scores two logits (no, yes) or a number."""

    def __init__(self, make: Callable[[], Callable[[list[tuple[str, str]]], Any]], *, batch: int = 32):
        self.make, self.batch = make, batch

    def rerank(self, candidates: DataFrame, claims: DataFrame, docs: DataFrame, top: int) -> DataFrame:
        make, size = self.make, self.batch
        rows = candidates.select("query_id", "doc_id").join(claims.select("query_id", F.col("text").alias("claim")), "query_id").join(docs.select("doc_id", "text"), "doc_id")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import math

            score = make()
            for f in frames:
                for i in range(0, len(f), size):
                    part = f.iloc[i : i + size]
                    got = score(list(zip(part["claim"], part["text"], strict=True)))
                    values = [1 / (1 + math.exp(g[0] - g[1])) if hasattr(g, "__len__") else float(g) for g in got]
                    yield part[["query_id", "doc_id"]].assign(score=values)

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("query_id", "doc_id"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
        return rows.select("query_id", "doc_id", "claim", "text").mapInPandas(work, f"{kinds}, score double").withColumn("rank", place).where(F.col("rank") <= top)


def make_reranker(config: dict[str, Any]) -> Reranker | None:
    """``none``, ``deterministic``, or ``local`` and ``remote`` with a ``make`` function of the caller's model or client."""
    kind = config.get("provider", "deterministic")
    if kind == "none":
        return None
    if kind == "deterministic":
        return OverlapReranker()
    if kind in ("local", "remote"):
        if not callable(config.get("make")):
            raise RuntimeError(f"a {kind} reranker needs a make function")
        return PairReranker(config["make"], batch=int(config.get("batch", 32)))
    raise ValueError(f"unknown reranker {kind}")


# -- verifiers ----------------------------------------------------------------------------------


class Verifier(ABC):
    """(query_id, text) claims and (query_id, doc_id, text, rank) evidence to (query_id, label, confidence, n_valid, abstain_reason, provider)."""

    name: str

    @abstractmethod
    def verify(self, claims: DataFrame, evidence: DataFrame) -> DataFrame: ...


class AbstainingVerifier(Verifier):
    name = "abstaining"

    def verify(self, claims: DataFrame, evidence: DataFrame) -> DataFrame:
        return claims.select(
            "query_id", F.lit("NOT_ENOUGH_INFO").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0).alias("n_valid"),
            F.lit("verifier_not_configured").alias("abstain_reason"), F.lit(self.name).alias("provider"),
        )


class FixtureVerifier(Verifier):
    """A contract fixture: the given label for every claim, citing the first evidence whole; without evidence it abstains."""

    name = "fixed-fixture"

    def __init__(self, label: str = "SUPPORTS"):
        self.label = label

    def verify(self, claims: DataFrame, evidence: DataFrame) -> DataFrame:
        first = evidence.where("rank = 1").select("query_id", "doc_id", F.col("text").alias("quote"))
        given = claims.select("query_id").join(first.select("query_id"), "query_id", "left_semi")
        judged = given.select("query_id", F.lit(self.label).alias("label"), F.lit(0.9).alias("confidence"))
        checked = verify.check_citations(judged, first, evidence)
        empty = claims.select("query_id").join(first.select("query_id"), "query_id", "left_anti").select(
            "query_id", F.lit("NOT_ENOUGH_INFO").alias("label"), F.lit(0.0).alias("confidence"), F.lit(0).alias("n_valid"), F.lit("empty_evidence").alias("abstain_reason")
        )
        return checked.unionByName(empty).withColumn("provider", F.lit(self.name))


class FunctionVerifier(Verifier):
    """A model's client, made once a worker: (claim, [(id, text)]) to a dict of label, confidence and citations [(id, quote)]. Its answers are checked, its errors abstain."""

    def __init__(self, name: str, make: Callable[[], Callable[[str, list[tuple[Any, str]]], dict]]):
        self.name, self.make = name, make

    def verify(self, claims: DataFrame, evidence: DataFrame) -> DataFrame:
        make = self.make
        held = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("e"))
        rows = claims.select("query_id", "text").join(held, "query_id", "left")
        kind, doc = rows.schema["query_id"].dataType.simpleString(), evidence.schema["doc_id"].dataType.simpleString()

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = make()
            for f in frames:
                out = []
                for query, text, e in zip(f["query_id"], f["text"], f["e"], strict=True):
                    try:
                        got = ask(text, [(x["doc_id"], x["text"]) for x in (e if e is not None else [])])
                        cites = [{"doc_id": i, "quote": q} for i, q in got.get("citations", ())]
                        out.append((query, got["label"], float(got["confidence"]), cites, None))
                    except (RuntimeError, ValueError, KeyError) as x:
                        out.append((query, "NOT_ENOUGH_INFO", 0.0, [], f"verifier_failure:{type(x).__name__}"))
                yield pd.DataFrame(out, columns=["query_id", "label", "confidence", "cites", "failure"])

        answered = rows.mapInPandas(work, f"query_id {kind}, label string, confidence double, cites array<struct<doc_id:{doc},quote:string>>, failure string")
        cites = answered.select("query_id", F.inline("cites"))
        checked = verify.check_citations(answered.select("query_id", "label", "confidence"), cites, evidence)
        failed = answered.select("query_id", "failure")
        return checked.join(failed, "query_id").select(
            "query_id", "label", "confidence", "n_valid", F.coalesce("failure", "abstain_reason").alias("abstain_reason"), F.lit(self.name).alias("provider")
        )
