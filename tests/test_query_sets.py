"""Which rows registered queries ask."""

from veritide.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_approximate_search_asks_every_twentieth_vector(spark):
    asked = {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    queries = catalogue.queries()
    assert asked and {r["query_id"] for r in queries["ivf_topk"](spark, SF).collect()} == asked
    assert {r["query_id"] for r in queries["ann_recall"](spark, SF).collect()} == asked


def test_grouped_public_split_takes_whole_texts(spark, tmp_path):
    split = catalogue.queries()["grouped_public_split"]

    def splits(folder, texts):
        rows = [(5 * i, text) for i, text in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        found = [r["split"] for r in split(spark, f"{tmp_path}/{folder}").collect()]
        assert len(found) == len(texts)
        return set(found)

    long = " ".join(f"word{k}" for k in range(60))
    assert splits("rest", ["title\n" + " ".join(f"w{i}x{k}" for k in range(20)) for i in range(20)]) == {"train", "validation", "test"}
    assert len(splits("first", [f"title{i}\n{long}" for i in range(20)])) == 1
