"""The pipeline against the same decisions by brute force."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import WORD, components_of, shingles
from veritide.llm import decontaminate, piece_codec


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    sf = tmp_path
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 90")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"].replace("\n", " ")
    base = " ".join(f"w{i}" for i in range(80))
    odd = [(1000, "... 123", "en"), (1001, base, "en"), (1002, base + " w80", "en"), (1003, f"some words before {item} and some words after it", "en"), (1004, None, "en")]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    docs.unionByName(odd).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    frame, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(sf))
        frame.write.parquet(f"{sf}/{k}")
        frame = spark.read.parquet(f"{sf}/{k}")
        kept.append({r["doc_id"]: r["text"] for r in frame.collect()})
        if name != "sentencepiece":
            assert frame.columns == columns

    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(kept[0]) == {i for i, t in start.items() if t and re.search(r"[^\W\d_]", t)}

    seen, after = [], {}
    for i in sorted(kept[0]):
        lines, own, lost = [], False, 0
        for line in kept[0][i].split("\n"):
            s = frozenset(WORD.findall(line.lower()))
            repeat = any(100 * len(s & o) >= 80 * len(s | o) for o in seen) if s else False
            if s:
                seen.append(s)
            if repeat:
                lost += 1
            else:
                lines.append(line)
                own |= bool(s)
        if own or not lost:
            after[i] = "\n".join(lines)
    assert kept[1] == after

    ids = sorted(after)
    sets = [shingles(after[i], 5) for i in ids]
    roots = components_of(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    first = {}
    for i, r in zip(ids, roots, strict=True):
        first.setdefault(r, i)
    assert set(kept[2]) == set(first.values())

    index = decontaminate.ItemIndex([(1, item)])
    assert set(kept[3]) == {i for i, t in kept[2].items() if not index.scan([t])} and 1003 not in kept[3]

    model = piece_codec.model_at(piece_codec.default_model())
    assert kept[4] == {i: model.decode(model.encode(t)) for i, t in kept[3].items()}
    whole = corpus_pipeline.run(spark, str(sf))
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(list(kept[4]))
