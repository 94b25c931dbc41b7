"""Readers of evidence, claims, predictions and rankings, and writers of JSON lines.

Keyed objects, lists and JSON lines are read alike; fields may have either of two names, and a
string in a keyed object is the text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names that a field may have, the first one first.
EVIDENCE = {"id": ("evidence_id", "id"), "text": ("text", "evidence_text")}
CLAIM = {"id": ("claim_id", "id"), "text": ("claim_text", "text", "claim"), "label": ("claim_label", "label"), "evidence_ids": ("evidences", "evidence_ids")}


def records(spark: SparkSession, path: str) -> DataFrame:
    """(place, key, value): every record of a file as VARIANT; key is null unless the file is a keyed object."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).withColumn("place", F.monotonically_increasing_id()).where(F.trim("value") != "")
        # the place is the line's number in its split, which an error names beside the line
        parsed = F.coalesce(F.try_parse_json("value"), F.raise_error(F.concat(F.lit(f"{path}: no JSON at line "), (F.col("place") % (1 << 33) + 1).cast("string"), F.lit(": "), F.left("value", F.lit(80)))).cast("variant"))
        return rows.select("place", F.lit(None).cast("string").alias("key"), parsed.alias("value"))
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    listed = whole.where(is_list).select(F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("place", "value"))
    keyed = whole.where(~is_list).select(F.posexplode(F.map_entries(F.variant_get("v", "$", "map<string,variant>"))).alias("place", "e"))
    return listed.select(F.col("place").cast("long").alias("place"), F.lit(None).cast("string").alias("key"), "value").unionByName(
        keyed.select(F.col("place").cast("long").alias("place"), F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    )


def _is_text() -> Column:
    return F.schema_of_variant("value") == "STRING"


def _field(names: tuple[str, ...], kind: str = "string") -> Column:
    return F.coalesce(*[F.when(~_is_text(), F.try_variant_get("value", f"$.{n}", kind)) for n in names])


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(evidence_id, text); a missing id or a repeated one is an error when rows are read."""
    rows = records(spark, path)
    ident = F.coalesce(_field(EVIDENCE["id"]), "key")
    text = F.when(_is_text(), F.variant_get("value", "$", "string")).otherwise(F.coalesce(_field(EVIDENCE["text"]), F.lit("")))
    n = F.count("*").over(Window.partitionBy("evidence_id"))
    checked = rows.select(F.coalesce(ident, F.raise_error(F.lit("evidence without an id"))).alias("evidence_id"), text.alias("text")).withColumn("n", n)
    return checked.select(
        F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated evidence id "), "evidence_id")).cast("string")).otherwise(F.col("evidence_id")).alias("evidence_id"), "text"
    )


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """(claim_id, text, label, evidence_ids); the last of equal ids counts, labels are upper-cased."""
    rows = records(spark, path)
    out = rows.select(
        F.coalesce(_field(CLAIM["id"]), "key", F.raise_error(F.lit("claim without an id"))).alias("claim_id"),
        F.when(_is_text(), F.variant_get("value", "$", "string")).otherwise(_field(CLAIM["text"])).alias("text"),
        F.upper(_field(CLAIM["label"])).alias("label"),
        F.coalesce(_field(CLAIM["evidence_ids"], "array<string>"), F.array().cast("array<string>")).alias("evidence_ids"),
        "place",
    )
    last = F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("place")))
    return out.withColumn("nth", last).where("nth = 1").drop("nth", "place")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(claim_id, label, evidence_ids, scores); the last of equal ids counts, scores are null where absent."""
    rows = records(spark, path)
    scores = F.when(~_is_text(), F.try_variant_get("value", "$.scores", "array<double>"))
    ident = F.coalesce(_field(CLAIM["id"]), "key")
    last = rows.groupBy(ident.alias("claim_id")).agg(F.max_by(F.struct(scores.alias("s")), "place").alias("last"))
    return read_claims(spark, path).select("claim_id", "label", "evidence_ids").join(last.select("claim_id", F.col("last.s").alias("scores")), "claim_id")


def read_prediction_variant(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """(claim_id, label, evidence_ids) of one model's rows in a mixed file.

    Rows without a claim or evidence ids are skipped; a claim twice, an id twice in a list, or no
    row at all is an error.
    """
    rows = records(spark, path).where(~_is_text())
    system = F.coalesce(_field(("model",)), _field(("system",)), F.lit(""))
    if variant is not None:
        rows = rows.where(system == variant)
    ids = F.try_variant_get("value", "$.evidence_ids", "array<string>")
    found = rows.select(F.coalesce(_field(("claim_id", "id")), "key").alias("claim_id"), F.upper(_field(("label", "claim_label"))).alias("label"), ids.alias("evidence_ids"))
    found = found.where("claim_id is not null and evidence_ids is not null")
    if found.isEmpty():
        raise ValueError(f"no predictions for {variant}")
    n = F.count("*").over(Window.partitionBy("claim_id"))
    wrong = F.when(F.col("n") > 1, F.lit("repeated prediction for ")).when(F.size("evidence_ids") != F.size(F.array_distinct("evidence_ids")), F.lit("repeated evidence in "))
    checked = F.when(wrong.isNull(), F.col("claim_id")).otherwise(F.raise_error(F.concat(wrong, "claim_id")).cast("string"))
    return found.withColumn("n", n).select(checked.alias("claim_id"), "label", "evidence_ids")


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claim_id, text, label) and (claim_id, evidence_id, label, article, text) of annotated claims in JSON lines; a repeated claim or one without evidence is an error."""
    each = "array<struct<evidence_id:string,evidence_label:string,article:string,evidence:string>>"
    rows = records(spark, path).select(
        F.variant_get("value", "$.claim_id", "string").alias("claim_id"), F.variant_get("value", "$.claim", "string").alias("text"),
        F.upper(F.variant_get("value", "$.claim_label", "string")).alias("label"), F.try_variant_get("value", "$.evidences", each).alias("evidences"),
    )
    if rows.isEmpty():
        raise ValueError("no claims")
    n = F.count("*").over(Window.partitionBy("claim_id"))
    wrong = F.when(F.col("n") > 1, F.lit("repeated claim ")).when(F.coalesce(F.size("evidences"), F.lit(0)) < 1, F.lit("no evidence for claim "))
    checked = F.when(wrong.isNull(), F.col("claim_id")).otherwise(F.raise_error(F.concat(wrong, "claim_id")).cast("string"))
    rows = rows.withColumn("n", n).withColumn("claim_id", checked)
    notes = rows.select("claim_id", F.explode("evidences").alias("e")).select(
        "claim_id", "e.evidence_id", F.upper("e.evidence_label").alias("label"), F.coalesce("e.article", F.lit("")).alias("article"), F.col("e.evidence").alias("text")
    )
    return rows.select("claim_id", "text", "label"), notes


def read_rankings(spark: SparkSession, path: str, default_source: str = "retriever") -> DataFrame:
    """(query_id, source, doc_id, score, rank) of three layouts.

    A keyed file maps claim -> source -> ids or objects; JSON lines hold a list of ids a row, or one
    ranked id a row. A bare id gets its place and 1 / rank; an object without a rank its place among its source's rows, without a score 0.
    """
    rows = records(spark, path)
    if path.endswith(".jsonl"):
        own = rows.select("place", _field(("claim_id",)).alias("query_id"), F.coalesce(_field(("source",)), F.lit(default_source)).alias("source"), "value")
        ids = F.try_variant_get("value", "$.evidence_ids", "array<string>")
        wide = own.where(ids.isNotNull()).select("query_id", "source", F.posexplode(ids).alias("at", "doc_id"))
        wide = wide.select("query_id", "source", "doc_id", (1 / (F.col("at") + 1)).alias("score"), (F.col("at") + 1).alias("rank"))
        nth = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("place"))
        long = own.where(ids.isNull()).withColumn("nth", nth)
        score = F.coalesce(F.try_variant_get("value", "$.score", "double"), F.lit(0.0))
        rank = F.coalesce(F.try_variant_get("value", "$.rank", "int"), "nth")
        return wide.unionByName(long.select("query_id", "source", _field(("evidence_id",)).alias("doc_id"), score.alias("score"), rank.alias("rank")))
    keyed = rows.select(F.col("key").alias("query_id"), F.explode(F.variant_get("value", "$", "map<string,array<variant>>")).alias("source", "items"))
    each = keyed.select("query_id", "source", F.posexplode("items").alias("at", "value"))
    rank = F.coalesce(F.when(~_is_text(), F.try_variant_get("value", "$.rank", "int")), F.col("at") + 1)
    ident = F.when(_is_text(), F.variant_get("value", "$", "string")).otherwise(_field(EVIDENCE["id"]))
    score = F.when(_is_text(), 1 / rank).otherwise(F.coalesce(F.try_variant_get("value", "$.score", "double"), F.lit(0.0)))
    return each.select("query_id", F.coalesce("source", F.lit(default_source)).alias("source"), ident.alias("doc_id"), score.alias("score"), rank.alias("rank"))


def predictions_of(ranked: DataFrame, *, final_k: int = 5) -> DataFrame:
    """(claim_id, evidence_ids): the first ``final_k`` ids of each claim's ranking; rows without a claim or id are skipped."""
    rows = ranked.where("query_id is not null and doc_id is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    return rows.where(F.col("rank") <= final_k).groupBy(F.col("query_id").alias("claim_id")).agg(listed.alias("evidence_ids"))


def read_retrieval_archive(spark: SparkSession, archive: str, folder: str, *, md5: str | None = None) -> dict[str, DataFrame]:
    """corpus (doc_id, text), queries (query_id, text) and qrels (query_id, doc_id) of a zip of corpus.jsonl, queries.jsonl and a qrels TSV.

    It is unpacked into ``folder``, which executors must share. Title and text are joined by a space; judgements above 0
    count; those that name an unknown id are an error when counted here.
    """
    import zipfile
    from pathlib import Path

    from ..files import check_archive

    if md5 is not None:
        check_archive(archive, md5)
    base = folder.removeprefix("file://")
    with zipfile.ZipFile(archive) as z:
        names = {want: next((n for n in z.namelist() if n.endswith(want)), None) for want in ("corpus.jsonl", "queries.jsonl", ".tsv")}
        if missing := [w for w, n in names.items() if n is None]:
            raise ValueError(f"archive lacks {missing}")
        for n in names.values():
            z.extract(n, base)
    paths = {w: f"file://{Path(base).resolve()}/{n}" for w, n in names.items()}
    corpus = spark.read.schema("_id string, title string, text string").json(paths["corpus.jsonl"])
    corpus = corpus.select(F.col("_id").alias("doc_id"), F.trim(F.concat_ws(" ", F.trim("title"), F.trim("text"))).alias("text"))
    queries = spark.read.schema("_id string, text string").json(paths["queries.jsonl"]).select(F.col("_id").alias("query_id"), "text")
    judged = spark.read.option("sep", "\t").option("header", True).csv(paths[".tsv"]).toDF("query_id", "doc_id", "score")
    qrels = judged.where(F.col("score").cast("int") > 0).select("query_id", "doc_id").distinct()
    if not qrels.join(corpus, "doc_id", "left_anti").isEmpty() or not qrels.join(queries, "query_id", "left_anti").isEmpty():
        raise ValueError("a judgement names an unknown id")
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line with sorted keys; the commit protocol makes it all or nothing."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).write.mode("overwrite").text(path)
