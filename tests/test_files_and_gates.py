"""Files, gates, readers, protocols, indexes and commands on small fixtures."""

import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veritide import cli, files
from veritide.operators import contracts, evaluation, index, protocols, ranking, serving, splitting, training
from veritide.operators.retrieval import BM25, recall_at_k
from veritide.sources import records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hashes(tmp_path, spark):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"one\ntwo\n")
    assert files.digest(tmp_path / "a/x.txt") == hashlib.sha256(b"one\ntwo\n").hexdigest()
    assert files.newline_sha256(tmp_path / "a/x.txt", "crlf") == hashlib.sha256(b"one\r\ntwo\r\n").hexdigest()
    want = hashlib.sha256(b"".join(len(v).to_bytes(8, "big") + v for v in (b"a", b"bc"))).hexdigest()
    assert files.ordered_id_sha256(["a", "bc"]) == want
    assert files.ordered_id_sha256(spark.createDataFrame([("bc",), ("a",)], "id string")) == want
    assert files.joined_id_sha256(["a", "b"]) == hashlib.sha256(b"a\0b").hexdigest()
    manifest = files.pack_stage(tmp_path / "a", tmp_path / "a.tar.gz")
    framed = len(b"x.txt").to_bytes(8, "big") + b"x.txt" + b"one\ntwo\n"
    assert manifest["tree_sha256"] == hashlib.sha256(framed).hexdigest()
    files.unpack_stage(tmp_path / "a.tar.gz", tmp_path / "b")
    assert rows(files.tree_sha256(spark, str(tmp_path / "b")), "sha256") == [(manifest["files"][0]["sha256"],)]
    (tmp_path / "b/x.txt").write_text("other")
    with pytest.raises(ValueError, match="x.txt"):
        files.check_tree(tmp_path / "b", manifest)
    got = files.fetch((tmp_path / "a/x.txt").as_uri(), tmp_path / "c" / "x")
    assert got["bytes"] == 8 and got["sha256"] == manifest["files"][0]["sha256"]
    with pytest.raises(ValueError):
        files.check_archive(tmp_path / "c/x", "0" * 32)


def test_configurations_and_runs(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "/here")
    files.write_json(tmp_path / "c.json", {"index": {"top-k": 7, "seed": 3, "other": 1}})
    merged = files.with_flags(files.load_config(tmp_path / "c.json", "index"), {"top_k": 5, "seed": 9, "path": "$PLACE/x"}, ["--seed", "9"])
    assert files.expanded(merged, ["path"]) == {"top_k": 7, "seed": 9, "path": "/here/x"}
    assert files.named_paths(["a=1", "b=2=3"], "runs") == {"a": "1", "b": "2=3"}
    for bad in (["a=1", "a=2"], ["=x"], ["a"], ["a="]):
        with pytest.raises(ValueError):
            files.named_paths(bad, "runs")
    with pytest.raises(ValueError, match="x, y"):
        files.required({"x": 0, "y": ""}, "x", "y")
    with pytest.raises(TypeError):
        files.member({"a": 1}, "a", "b")
    start = "2020-01-01T00:00:00+00:00"
    files.write_run(tmp_path / "run", command="c", arguments={"a": 1, "f": print}, metrics={"m": 0.5}, started_at=start, inputs={"i": str(tmp_path / "c.json")}, predictions=[{"b": 1, "a": "é"}])
    made = files.read_json(tmp_path / "run/run_manifest.json")
    assert made["arguments"] == {"a": 1} and made["finished_at"] > made["started_at"] and made["inputs"]["i"]["sha256"] == files.digest(tmp_path / "c.json")
    assert (tmp_path / "run/predictions.jsonl").read_text() == '{"a": "é", "b": 1}\n' and "m: 0.5" in (tmp_path / "run/report.md").read_text()
    assert list(files.secrets({"k": ["x", "AKIA" + "A" * 16]}, {"key": r"AKIA[0-9A-Z]{16}"})) == [("$.k[1]", "key")]
    with pytest.raises(ValueError):
        files.publication({"a": "/home/me"}, patterns={"path": "/home/"}, fields=["a"])


def test_ledger_and_metrics_files(tmp_path):
    path, sha = tmp_path / "l.json", "a" * 64
    files.reserve_transfer(path, config_sha256=sha, attempt="1")
    with pytest.raises(ValueError):
        files.reserve_transfer(path, config_sha256="b" * 64, attempt="2")
    for k in "23":
        files.reserve_transfer(path, config_sha256=sha, attempt=k)
    with pytest.raises(ValueError, match="attempt"):
        files.reserve_transfer(path, config_sha256=sha, attempt="4")
    with pytest.raises(ValueError):
        files.complete_transfer(path, attempt="1", metrics_sha256=sha)
    assert files.complete_transfer(path, attempt="3", metrics_sha256=sha)["status"] == "completed"
    with pytest.raises(ValueError):
        files.reserve_transfer(path, config_sha256=sha, attempt="5")
    files.write_json(tmp_path / "m.json", {"adapter_config_id": "x"})
    assert set(files.load_metrics_files([tmp_path / "m.json"])) == {"x"}
    with pytest.raises(ValueError):
        files.load_metrics_files([tmp_path / "m.json"] * 2)


def test_accounting(spark, tmp_path):
    line = "7|train|gpu|cpu=1|4G|1:00||COMPLETED|0:0|\n7.batch|batch||cpu=1||1:00|9K|COMPLETED|0:0|\n7.extern|extern||cpu=1||1:00|1K|COMPLETED|0:0|\n"
    (tmp_path / "a.txt").write_text(line)
    assert rows(files.job_accounting(spark, str(tmp_path / "a.txt")), "job_id", "job_name", "max_rss") == [("7", "train", "9K")]


def test_gates(tmp_path):
    up = {"mean_difference": 0.1, "ci_lower": 0.01}
    run = lambda r, n, ok: {"candidate": {"recall@5": r, "ndcg@10": n}, "paired_bootstrap": {"recall@5": up if ok else {"mean_difference": 0.1, "ci_lower": -1}}}
    assert contracts.choose_full({"a": run(0.5, 0.1, False), "b": run(0.4, 0.2, True)})["selected"] == "b"
    best = contracts.choose_full({"a": run(0.5, 0.1, False), "b": run(0.5, 0.2, False)})
    assert best["selected"] == "b" and not best["selected_promoted"] and contracts.choose_full({})["selected"] is None
    with pytest.raises(ValueError):
        contracts.choose_full(dict.fromkeys("abc", run(1, 1, True)))
    assert contracts.screened({"recall@5": up})["passed"]
    files.write_json(tmp_path / "p.json", {"frozen_test": {"status": "consumed", "consumed_system_id": "s", "exact_baseline_reproduction_allowed": True}})
    policy = lambda **k: contracts.test_policy(tmp_path / "p.json", **k)
    assert policy(split="validation", system_id="x") == "allowed_non_test_split"
    assert policy(split="test", system_id="s", exact_reproduction=True).startswith("allowed_exact")
    for k in ({"system_id": "s"}, {"system_id": "x", "exact_reproduction": True}):
        with pytest.raises(ValueError):
            policy(split="test", **k)
    one = {"candidate_width": 100, "feature_names": ["a"], "reachable_positive_rate": 1.0, "candidate_source_distribution": {"both": 3, "bm25_only": 1},
           "reachable_positive_id_sha256": "c" * 64, "training_reachable_positive_id_sha256": "c" * 64, "positive_policy": "candidate-supported-only"}
    assert contracts.train_serve_audit(one, one)["status"] == "passed"
    other = contracts.train_serve_audit(one, one | {"candidate_source_distribution": {"both": 1, "bm25_only": 1}, "candidate_width": 50})
    assert other["total_variation"] == 0.25 and [k for k, v in other["checks"].items() if not v] == ["candidate_width_equal", "candidate_source_total_variation_within_limit"]
    protocol = {"dataset": {"n": 3}, "adapters": [{"id": 1}, {"id": 2}]}
    contracts.check_protocol(protocol, {"x": {"y": True}}, {"dataset.n": 3, "adapters": 2, "policy:x.y": True})
    with pytest.raises(ValueError, match="dataset.m.*adapters"):
        contracts.check_protocol(protocol, {}, {"dataset.m": 1, "adapters": 3})
    sha = "d" * 64
    files.write_json(tmp_path / "c.json", dict.fromkeys(("corpus_sha256", "claims_sha256", "qrels_sha256", "split_sha256", "config_sha256"), sha) | {"system_id": "s", "track": "t", "split": "v", "candidate_width": 100, "final_k": 5})
    assert contracts.RunContract.load(tmp_path / "c.json").final_k == 5


def test_readers(spark, tmp_path):
    wide = [{"claim_id": "c", "source": "a", "evidence_ids": ["x", "y"]}, {"claim_id": "c", "source": "b", "evidence_id": "z", "score": 3}, {"claim_id": "c", "source": "b", "evidence_id": "w"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, wide)))
    assert rows(records.read_rankings(spark, str(tmp_path / "r.jsonl")), "source", "rank", "doc_id", "score") == [("a", 1, "x", 1.0), ("a", 2, "y", 0.5), ("b", 1, "z", 3.0), ("b", 2, "w", 0.0)]
    mixed = [{"claim_id": "c", "model": "m", "evidence_ids": ["x"], "label": "supports"}, {"claim_id": "c", "system": "n", "evidence_ids": ["y"]}, {"claim_id": "d", "model": "m"}]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, mixed)))
    assert rows(records.read_prediction_variant(spark, str(tmp_path / "v.jsonl"), "m"), "claim_id", "label") == [("c", "SUPPORTS")]
    with pytest.raises(ValueError):
        records.read_prediction_variant(spark, str(tmp_path / "v.jsonl"), "z")
    with pytest.raises(Exception, match="repeated prediction"):
        records.read_prediction_variant(spark, str(tmp_path / "v.jsonl")).collect()
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{nope\n')
    with pytest.raises(Exception, match="no JSON at line 3"):
        records.records(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "p.json").write_text(json.dumps({"c": {"label": "refutes", "evidence_ids": ["x"], "scores": [0.5]}}))
    assert rows(records.read_predictions(spark, str(tmp_path / "p.json")), "claim_id", "label", "scores") == [("c", "REFUTES", [0.5])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("s/corpus.jsonl", '{"_id": "1", "title": " T ", "text": "x "}\n')
        z.writestr("s/queries.jsonl", '{"_id": "q", "text": "?"}\n')
        z.writestr("s/qrels/test.tsv", "query-id\tcorpus-id\tscore\nq\t1\t1\n")
    got = records.read_retrieval_archive(spark, str(tmp_path / "z.zip"), str(tmp_path / "un"), md5=files.digest(tmp_path / "z.zip", "md5"))
    assert rows(got["corpus"], "doc_id", "text") == [("1", "T x")] and rows(got["qrels"], "query_id", "doc_id") == [("q", "1")]
    ranked = spark.createDataFrame([("c", f"d{k}", k) for k in range(1, 9)], "query_id string, doc_id string, rank int")
    assert rows(records.predictions_of(ranked, final_k=3), "claim_id", "evidence_ids") == [("c", ["d1", "d2", "d3"])]


def annotated(tmp_path):
    note = lambda i, text, label="SUPPORTS": {"evidence_id": i, "evidence_label": label, "article": "A", "evidence": text}
    claims = [
        ("1", "Ice melts fast", [note("e1", "one two three four five six seven eight nine ten")]),
        ("2", "ice MELTS, fast!", [note("e2", "another text")]),
        ("3", "Seas rise", [note("e2", "another text"), note("e3", "lonely")]),
        ("4", "Forests burn", [note("e4", "one two three four five six seven eight nine ten", "refutes")]),
        ("5", "Winds blow", [note("e5", "wholly its own")]),
        ("6", "Rain falls", [note("e6", "words of rain")]),
    ]
    path = tmp_path / "claims.jsonl"
    path.write_text("\n".join(json.dumps({"claim_id": i, "claim": c, "claim_label": "supports", "evidences": e}) for i, c, e in claims))
    return str(path)


def test_splits(spark, tmp_path):
    claims, notes = records.read_annotated(spark, annotated(tmp_path))
    assert splitting.public_corpus(notes).count() == 6
    split = splitting.grouped_split(claims, notes)
    by = {}
    for r in split.collect():
        by.setdefault(r["component"], set()).add(r["claim_id"])
    assert sorted(map(sorted, by.values())) == [["1", "2", "3", "4"], ["5"], ["6"]]
    splitting.check_split(claims, notes, split)
    report = splitting.audit(claims, notes, split)
    assert report["status"] == report["supervised_relevance_status"] == "passed"
    bad = claims.select("claim_id", F.when(F.col("claim_id").isin("1", "3"), "train").otherwise("test").alias("split"))
    with pytest.raises(ValueError, match="shared_evidence"):
        splitting.check_split(claims, notes, bad)
    report = splitting.audit(claims, notes, bad)
    assert report["status"] == "failed" and report["normalised_claim_duplicate_cross_split"] == 1 and report["near_duplicate_evidence_pairs_cross_split"] == 1
    assert report["shared_decisive_evidence_id_cross_split"] == 1 and report["near_duplicate_claim_examples"][0]["left_splits"] == ["train"]
    seal = splitting.export_splits(claims, split, f"file://{tmp_path}/out")
    assert not any((tmp_path / "out").glob("test/*")) and sum(s["count"] for s in seal.values()) == 6
    ids = splitting.pilot_ids([str(i) for i in range(20)], size=5, seed=1)
    assert ids == sorted(ids) and len(ids) == 5 and ids == splitting.pilot_ids([str(i) for i in range(19, -1, -1)], size=5, seed=1)
    with pytest.raises(Exception, match="inconsistent"):
        splitting.public_corpus(notes.unionByName(notes.limit(1).withColumn("text", F.lit("x")))).collect()


def test_claim_edges_of_copies_grow_with_the_claims(spark):
    n, line = 120, " ".join(f"word{i}" for i in range(40))
    claims = spark.createDataFrame([(f"{i:03d}", line if i % 2 else f"{line} x{i}") for i in range(n)], "claim_id string, text string")
    notes = spark.createDataFrame([(f"{i:03d}", f"e{i}", "SUPPORTS", f"note {line}" if i % 2 else f"note {line} y{i}") for i in range(n)], "claim_id string, evidence_id string, label string, text string")
    edges = splitting.claim_edges(claims, notes)
    assert edges.count() < 8 * n
    split = splitting.grouped_split(claims, notes)
    assert {r["component"] for r in split.collect()} == {"000"} and split.count() == n


def test_protocols_and_service(spark):
    docs = spark.createDataFrame([(1, "melting glaciers raise oceans quickly"), (2, "forests absorb carbon dioxide"), (3, "coal plants emit smoke")], "doc_id long, text string")
    claims = spark.createDataFrame([(7, "glaciers raise oceans"), (8, "unknown nonsense words")], "query_id long, text string")
    evidence = docs.limit(0).withColumn("query_id", F.lit(0)).withColumn("rank", F.lit(1))
    made = spark.createDataFrame([(7, 1, "melting glaciers raise oceans quickly", 1)], "query_id long, doc_id long, text string, rank int")
    got = {r["query_id"]: r for r in protocols.FixtureVerifier().verify(claims, made).collect()}
    assert (got[7]["label"], got[7]["confidence"], got[8]["abstain_reason"]) == ("SUPPORTS", 0.9, "empty_evidence")
    assert {r["label"] for r in protocols.AbstainingVerifier().verify(claims, evidence).collect()} == {"NOT_ENOUGH_INFO"}

    def make():
        def ask(text, found):
            if not found:
                raise KeyError("x")
            return {"label": "REFUTES", "confidence": 0.8, "citations": [(found[0][0], "raise  OCEANS")]}

        return ask

    got = {r["query_id"]: r for r in protocols.FunctionVerifier("f", make).verify(claims, made).collect()}
    assert got[7]["label"] == "REFUTES" and got[8]["abstain_reason"] == "verifier_failure:KeyError"
    pairs = claims.crossJoin(docs.select("doc_id")).select("query_id", "doc_id")
    scored = protocols.PairReranker(lambda: lambda ps: [float(len(set(a.split()) & set(b.split()))) for a, b in ps]).rerank(pairs, claims, docs, 1)
    assert rows(scored, "query_id", "doc_id") == [(7, 1), (8, 1)]
    assert protocols.make_reranker({"provider": "none"}) is None and isinstance(protocols.make_reranker({}), protocols.OverlapReranker)
    for bad in ({"provider": "local"}, {"provider": "x"}):
        with pytest.raises((RuntimeError, ValueError)):
            protocols.make_reranker(bad)
    assert protocols.dtype_name("bf16") == "bfloat16"
    service = serving.Service(docs, BM25.fit(docs).search, verifier=protocols.FixtureVerifier())
    status, found = service.handle("POST", "/api/verify", {"claim_text": "glaciers raise oceans", "top_k": 1})
    assert status == 200 and found["verdict"]["label"] == "SUPPORTS" and found["evidence"][0]["evidence_id"] == 1
    assert service.handle("GET", f"/api/traces/{found['trace_id']}", {})[0] == 200 and service.handle("GET", "/api/traces/x", {})[0] == 404
    for bad in ({}, {"claim_text": ""}, {"claim_text": "x" * 10_001}, {"claim_text": "x", "top_k": 0}):
        assert service.handle("POST", "/api/search", bad)[0] == 422
    assert 'requests_total{route="/api/search",status="error"} 4' in service.handle("GET", "/metrics", {})[1]


def test_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} third{i}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "word3 other2"), (2, "third9")], "query_id long, text string")
    built = BM25.fit(docs)
    index.save_bm25(built, f"{tmp_path}/bm25", buckets=4)
    kept = index.load_bm25(spark, f"{tmp_path}/bm25")
    want = rows(built.search(asked, 5), "query_id", "rank", "doc_id", "score")
    assert want and rows(kept.search(asked, 5), "query_id", "rank", "doc_id", "score") == want
    with pytest.raises(ValueError):
        BM25.fit(docs.unionByName(docs.limit(1)))
    named, encoder = docs.withColumnRenamed("doc_id", "id"), protocols.HashEncoder(32)
    dense = index.cached(named, encoder, f"{tmp_path}/dense")
    assert dense.count == 60 and index.DenseIndex.load(spark, f"{tmp_path}/dense", encoder, named).count == 60
    with pytest.raises(ValueError):
        index.DenseIndex.load(spark, f"{tmp_path}/dense", encoder, named.limit(59))
    with pytest.raises(ValueError):
        index.DenseIndex.load(spark, f"{tmp_path}/dense", protocols.HashEncoder(16))
    first = dense.search(spark.createDataFrame([(0, "third9 word2 other4")], "id long, text string"), 1).first()
    assert first["doc_id"] == 9 and first["score"] > 0.99
    lengths = protocols.FunctionEncoder("len", 1, lambda: lambda texts: [[len(t)] for t in texts])
    assert lengths.documents(named.where("id = 0")).first()["embedding"] == [18.0]


def test_quantised_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    codes, books = index.product_quantised(e, parts=16, codes=16)
    asked = e.where("id % 20 = 0")
    found = index.quantised_top_k(codes, books, asked, 10)
    assert codes.count() == e.count() and found.count() == 10 * asked.count()
    from veritide.operators.ann import ivf_top_k
    from veritide.operators.retrieval import dense_top_k

    raw = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = raw.where("vec_id % 20 = 0")
    recall = recall_at_k(dense_top_k(raw, q, 10), ivf_top_k(raw, q, 10, cells=16, probes=14), 10).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def test_training_rows(spark):
    claims = spark.createDataFrame([("a", "claim"), ("b", "other")], "query_id string, text string")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)] + [(8, "TEXT  1"), (9, "text 0")], "doc_id long, text string")
    gold = spark.createDataFrame([("a", 0), ("b", 1)], "query_id string, doc_id long")
    neg = spark.createDataFrame([("a", d, r) for r, d in enumerate((9, 0, 1, 8, 2, 3), 1)] + [("b", 2, 1)], "query_id string, doc_id long, rank int")
    got, skipped = training.infonce_rows(claims, docs, gold, neg, per_positive=3, instruction="i")
    r = got.first()
    assert got.count() == 1 and [m[0]["content"] for m in r["negatives"]] == ["text 1", "text 2", "text 3"] and r["messages"][0]["role"] == "system"
    assert rows(skipped, "query_id") == [("b",)]
    some = training.preserving_sample(docs, gold, size=5, seed=1)
    assert some.count() == 5 and some.where("doc_id in (0, 1)").count() == 2
    with pytest.raises(ValueError):
        training.preserving_sample(docs, gold, size=1, seed=1)


def test_rankers_are_kept(spark, tmp_path):
    data = [(q, d, 2 if d == 0 else 0, float(d == 0) + d / 100, float(d)) for q in range(6) for d in range(5)]
    table = spark.createDataFrame(data, "query_id int, doc_id int, relevance int, x double, y double")
    linear = ranking.train_ranker(table, ["x", "y"])
    ranking.save_ranker(linear, f"{tmp_path}/r.json")
    trees = ranking.train_ranker(table, ["x", "y"], kind="trees")
    trees.trees = 3
    ranking.save_ranker(trees, f"{tmp_path}/t")
    for path in (f"{tmp_path}/r.json", f"{tmp_path}/t"):
        assert rows(ranking.ranked_by(ranking.load_ranker(path), table, top=1), "doc_id") == [(0,)] * 6
    with pytest.raises(RuntimeError):
        ranking.train_ranker(table, ["x"], kind="lambdamart")
    hashed = ranking.text_route_features(spark.createDataFrame([(1, "Not a [2] test?")], "query_id int, text string"), dimensions=16).first()
    terms, want = "not a 2 test".split(), [0.0] * 16
    for t in terms + [f"{a}_{b}" for a, b in zip(terms, terms[1:], strict=False)]:
        v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        want[v % 16] += 1.0 if v & 1 else -1.0
    norm = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / norm) < 1e-12 for a, b in zip(hashed["hashed"], want, strict=True)) and hashed["text_bracket_count"] == 2


def test_representation_report(spark):
    claims = spark.createDataFrame([(i, "t", None) for i in range(4)], "query_id int, text string, label string")
    gold = spark.createDataFrame([(i, i) for i in range(4)], "query_id int, doc_id int")
    run = lambda hit: spark.createDataFrame([(i, None, [i if hit(i) else 99]) for i in range(4)], "query_id int, label string, evidence_ids array<int>")
    tags = spark.createDataFrame([(i, "entity") for i in range(3)], "query_id int, tag string")
    got = evaluation.representation_report(claims, gold, run(lambda i: i < 1), run(lambda i: i < 3), tags)
    assert got["paired_bootstrap"]["recall_5"]["mean_difference"] == 0.5 and "claim_accuracy" not in got["baseline"]
    assert got["taxonomy"]["entity"]["query_count"] == 3 and got["taxonomy"]["spelling"]["delta_mrr_10"] is None and len(got["taxonomy"]) == 8
    with pytest.raises(ValueError):
        evaluation.representation_report(claims, gold, run(lambda i: True).limit(3), run(lambda i: True), tags)


def test_commands(spark, tmp_path, capsys):
    path = annotated(tmp_path)
    (tmp_path / "bad.json").write_text("\n".join(json.dumps({"claim_id": str(i), "split": "train" if i < 5 else "test"}) for i in range(1, 6)))
    assert cli.main(["audit-public-split", "--claims", path, "--split", f"{tmp_path}/bad.json"]) == 2
    assert cli.main(["build-pareto"]) == 2
    files.write_json(tmp_path / "claims.json", {"c": {"claim_text": "ice", "claim_label": "SUPPORTS", "evidences": ["e"]}})
    files.write_json(tmp_path / "pred.json", {"c": {"claim_label": "SUPPORTS", "evidences": ["e"]}})
    assert cli.main(["evaluate", "--claims", str(tmp_path / "claims.json"), "--predictions", str(tmp_path / "pred.json"), "--output", f"{tmp_path}/run"]) == 0
    assert files.read_json(tmp_path / "run/metrics.json")["harmonic_mean"] == 1.0
