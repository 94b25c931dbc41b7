"""Exact values on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.functions import text as T
from veritide.operators import contracts, dedup, fusion, metrics, ranking
from veritide.operators.retrieval import BM25, dense_top_k, hybrid, recall_at_k

EVIDENCE = {
    "e1": "Human carbon dioxide emissions raise the heat that stays in the air, many studies find.",
    "e2": "Arctic ice covered less water in 2020 than in 1979.",
    "e3": "Bakers let CO2 lift their dough.",
    "e4": "",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(EVIDENCE.items()), "doc_id string, text string")


def test_tokens_keep_negations_and_fold_carbon_dioxide(spark):
    rows = spark.createDataFrame([("CO2 does not warm the air without sunlight",), ("Carbon  dioxide é1 café x",)], "t string")
    got = [r[0] for r in rows.select(T.tokens(F.col("t"))).collect()]
    assert got == [["carbon_dioxide", "does", "not", "warm", "air", "without", "sunlight"], ["carbon_dioxide"]]


def test_bm25_orders_and_rejects(spark, docs):
    index = BM25.fit(docs)
    q = spark.createDataFrame([("q1", "human carbon dioxide emissions"), ("q2", "unknownword"), ("q3", "Arctic ice 1979")], "query_id string, text string")
    got = [(r["query_id"], r["doc_id"], r["rank"]) for r in index.search(q, 2).orderBy("query_id", "rank").collect()]
    assert got == [("q1", "e1", 1), ("q1", "e3", 2), ("q3", "e2", 1)]
    assert index.search(q, 0).count() == 0
    for bad in (lambda: BM25.fit(docs, k1=0), lambda: BM25.fit(docs, b=2), lambda: BM25.fit(docs.limit(0)), lambda: BM25.fit(docs.union(docs))):
        with pytest.raises(ValueError):
            bad()


def test_rank_fusion_ties_go_to_the_smaller_id(spark):
    rows = [("q", "bm25", "b", 1), ("q", "bm25", "a", 2), ("q", "dense", "a", 1), ("q", "dense", "b", 2)]
    r = spark.createDataFrame(rows, "query_id string, source string, doc_id string, rank int")
    assert [x["doc_id"] for x in fusion.reciprocal_rank_fusion(r).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(r, k=0)
    one = r.where("source = 'bm25'").withColumn("score", 1 / F.col("rank"))
    assert [x["doc_id"] for x in hybrid({"bm25": one}, final_k=1).collect()] == ["b"]


def test_weighted_fusion_and_negatives(spark):
    base = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, doc_id string, rank int")
    other = spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "query_id string, doc_id string, rank int")
    got = fusion.weighted_rank_fusion(base, other, top=5, k=0, base_weight=2).orderBy("rank").collect()
    assert [(r["doc_id"], r["base_rank"], r["reranker_rank"]) for r in got] == [("a", 1, 2), ("b", 2, 1)]
    rankings = base.withColumn("source", F.lit("bm25")).unionByName(other.withColumn("source", F.lit("dense")))
    neg = fusion.hard_negatives(rankings, spark.createDataFrame([("q", "a")], "query_id string, doc_id string")).collect()
    assert [(r["doc_id"], r["best_rank"], r["sources"]) for r in neg] == [("b", 1, {"bm25": 2, "dense": 1})]


def test_dense_search_equals_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = dense_top_k(df, df.where("vec_id < 5"), 4, block=2)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(5):
        want = np.argsort(-(u @ u[i]))[:4].tolist()
        assert [r["doc_id"] for r in got.where(F.col("query_id") == i).orderBy("rank").collect()] == want
    assert {r["recall"] for r in recall_at_k(got, got, 4).collect()} == {1.0}


def test_retrieval_metrics_and_bootstrap(spark):
    claims = spark.createDataFrame([("c1",), ("c2",)], "query_id string")
    gold = spark.createDataFrame([("c1", "a"), ("c1", "b")], "query_id string, doc_id string")
    ranked = spark.createDataFrame([("c1", "x", 1), ("c1", "a", 2)], "query_id string, doc_id string, rank int")
    got = {r["query_id"]: r for r in metrics.retrieval_metrics(claims, ranked, gold).collect()}
    assert got["c1"]["recall_5"] == 0.5 and got["c1"]["mrr_10"] == 0.5 and got["c1"]["evidence_f1"] == 0.5
    assert got["c2"]["recall_5"] == 0 and got["c2"]["ndcg_10"] == 0
    rows = spark.createDataFrame([("m", i, float(i > 1), 1.0) for i in range(4)], "metric string, id int, base double, candidate double")
    b = metrics.paired_bootstrap(rows, by="metric").first()
    assert b["mean_difference"] == 0.5 and b["ci_lower"] >= 0


def test_pairs_components_and_split(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, base), (2, base + " x"), (3, base), (4, "other words here"), (5, "!!")], "doc_id long, text string")
    pairs = {tuple(r) for r in dedup.near_duplicate_pairs(rows).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "left_id long, right_id long")
    nodes = spark.range(1, 7).select(F.col("id"))
    assert {tuple(r) for r in dedup.components(nodes, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    split = dedup.grouped_split([(i, 1) for i in range(100)])
    assert split == dedup.grouped_split([(i, 1) for i in range(100)]) and sorted(set(split.values())) == ["test", "train", "validation"]


def _sized(rng, n):
    return {f"w{x}" for x in rng.choice(4000, n, replace=False)}


def test_near_pairs_and_links_equal_brute_force(spark, monkeypatch):
    rng, sets = np.random.default_rng(5), []
    for n in (1, 2, 8, 9, 10, 11, 19, 30, 31, 60, 120, 400):
        for _ in range(3):
            base = sorted(_sized(rng, n))
            sets += [base, base]
            for change in (1, n // 20 + 1, n // 12 + 1, n // 9 + 1):
                sets.append(sorted(set(base[: max(0, n - change)]) | _sized(rng, change)))
            sets += [base[:-1], [*base, "x"], [*base, "x", "y"]]
    data = list(enumerate(" ".join(s) for s in sets))
    sets = [set(s) for s in sets]
    n = len(sets)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(dedup, "BLOCK", 4)
    assert {tuple(r) for r in dedup.near_duplicate_pairs(rows).collect()} == want
    nodes = rows.select(F.col("doc_id").alias("id"))
    found = {r["id"]: r["component"] for r in dedup.components(nodes, dedup.near_duplicate_links(rows)).collect()}
    edges = spark.createDataFrame(sorted(want), "left_id long, right_id long")
    assert found == {r["id"]: r["component"] for r in dedup.components(nodes, edges).collect()} and len(set(found.values())) < n


def test_links_of_copies_and_near_copies_grow_with_the_rows(spark):
    base = [f"w{i}" for i in range(40)]
    rows = spark.createDataFrame([(i, " ".join([*base, f"x{i % 60}"])) for i in range(180)], "doc_id long, text string")
    assert dedup.near_duplicate_links(rows).count() < 3 * 180
    assert dedup.near_duplicate_pairs(rows).count() == 180 * 179 // 2


def test_pareto_counts_equal_brute_force_and_no_pairs_are_made(spark):
    rng = np.random.default_rng(3)
    odd = [None, float("nan"), 0.0, -0.0]
    data = [(i, "ab"[i % 2] if i % 19 else None, int(rng.integers(0, 9)), odd[i % 4] if i % 11 == 0 else float(rng.integers(0, 6)), int(rng.integers(0, 4))) for i in range(150)]
    df = spark.createDataFrame(data, "id long, of string, x int, y double, z int").repartition(3)
    high = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731 NaN is the largest, as in Spark
    for up, down in ((["x"], ["y"]), (["x"], []), (["y", "x"], ["z"])):
        want = {}
        for a in data:
            sign = [(dict(id=0, of=1, x=2, y=3, z=4)[c], s) for s, cs in ((1, up), (-1, down)) for c in cs]
            n = 0
            for b in data:
                if a[1] is None or a[1] != b[1] or any(r[k] is None for k, _ in sign for r in (a, b)):
                    continue
                ahead = [(high(b[k]) > high(a[k])) - (high(b[k]) < high(a[k])) for k, _ in sign]
                ahead = [x * s for x, (_, s) in zip(ahead, sign, strict=True)]
                n += min(ahead) >= 0 and max(ahead) > 0
            want[a[0]] = n
        out = metrics.pareto_front(df, group="of", name="id", maximise=up, minimise=down)
        assert {r["id"]: r["dominated_by"] for r in out.collect()} == want
        assert all(r["on_front"] == (r["dominated_by"] == 0) for r in out.collect())
    many = spark.range(200_000).select("id", F.lit(1).alias("of"), (F.col("id") % 1000).alias("x"), F.col("id").alias("y"))
    assert metrics.pareto_front(many, group="of", name="id", maximise=["x"], minimise=["y"]).agg(F.sum("dominated_by")).first()[0] == 9_959_950_000


def test_rankers(spark):
    rows = [("q%d" % (i // 4), i, float(i % 4), 2 if i % 4 == 3 else 0) for i in range(24)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, f double, relevance int")
    model = ranking.PairwiseRanker(["f"], epochs=20).fit(df)
    assert ranking.pairwise_accuracy(df.withColumn("score", model.score())).first()["accuracy"] == 1.0
    again = ranking.PairwiseRanker.from_dict(json.loads(json.dumps(model.to_dict())))
    assert again.weights.tolist() == model.weights.tolist()
    with pytest.raises(ValueError):
        ranking.PairwiseRanker(["f"]).fit(df.withColumn("relevance", F.lit(0)))
    line = spark.createDataFrame([(float(i), float(i)) for i in range(4)], "x double, y double")
    ridge = ranking.RidgeModel(["x"], penalty=0.0).fit(line, "y")
    assert line.limit(1).select(F.lit(1.5).alias("x")).select(ridge.score()).first()[0] == pytest.approx(1.5)


def test_contracts():
    h = "0" * 64
    a = contracts.RunContract("a", "t", "dev", h, h, h, h, h, 100, 5).check()
    b = contracts.RunContract("b", "t", "dev", h, h, h, h, h, 50, 5).check()
    assert contracts.mismatches(a, b) == ["candidate_width"] and "system_id" in contracts.mismatches(a, a)
    with pytest.raises(ValueError):
        contracts.RunContract("a", "t", "dev", h, h, h, h, "x", 100, 5).check()
    assert contracts.promoted({"recall@5": {"mean_difference": 0.1, "ci_lower": 0.01}, "mrr@10": {"mean_difference": 0.0}})
    assert contracts.advance({"p": {"recall@5": 0.0}, "q": {"recall@5": -1.0}}) == ([], "p")
    contracts.may_use_test("test", None, "a")
    with pytest.raises(PermissionError):
        contracts.may_use_test("test", "a", "b")


def test_readers(spark, tmp_path):
    from veritide.sources import records

    (tmp_path / "e.json").write_text(json.dumps({"e1": "text one", "e2": {"evidence_text": "two"}}))
    (tmp_path / "l.json").write_text(json.dumps([{"id": "e1", "text": "text one"}, {"evidence_id": "e2", "text": "two"}]))
    (tmp_path / "j.jsonl").write_text('{"id": "e1", "text": "text one"}\n\n{"id": "e2", "text": "two"}\n')
    for name in ("e.json", "l.json", "j.jsonl"):
        assert {tuple(r) for r in records.read_evidence(spark, str(tmp_path / name)).collect()} == {("e1", "text one"), ("e2", "two")}
    (tmp_path / "c.json").write_text(json.dumps({"c1": {"claim_text": "t", "claim_label": "supports", "evidences": ["e1"]}, "c2": {"text": "u"}}))
    assert {(r["claim_id"], r["text"], r["label"], tuple(r["evidence_ids"])) for r in records.read_claims(spark, str(tmp_path / "c.json")).collect()} == {
        ("c1", "t", "SUPPORTS", ("e1",)), ("c2", "u", None, ()),
    }
    (tmp_path / "r.json").write_text(json.dumps({"c1": {"bm25": [{"evidence_id": "e1", "score": 4.0, "rank": 1}], "dense": ["e2", "e1"]}}))
    got = {tuple(r) for r in records.read_rankings(spark, str(tmp_path / "r.json")).collect()}
    assert got == {("c1", "bm25", "e1", 4.0, 1), ("c1", "dense", "e2", 1.0, 1), ("c1", "dense", "e1", 0.5, 2)}


def test_streams(spark, tmp_path):
    from veritide.streaming import service

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = service.windowed_latency(stream, width="1 day").writeStream.format("memory").queryName("latency").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latency").agg(F.sum("n")).first()[0] == events.count()


def test_entry_and_catalogue_agree(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and "bm25_topk" in sql
    assert e.entry(spark).limit(1).count() == 1
