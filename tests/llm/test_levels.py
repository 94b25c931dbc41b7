"""Levels at which registered queries and stages take texts for copies."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SF, WORD, shingles
from veritide.llm import line_dedup, parity_join


def share(a, b):
    return 100 * len(a & b) / len(a | b)


def grams(text, size):
    words = text.split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_near_copies_meet_on_five_words_at_80(spark):
    words = [f"w{i}" for i in range(200)]
    near = [f"z{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]
    far = [f"y{i}" if i in (20, 60, 100, 140, 175) else w for i, w in enumerate(words)]
    texts = [" ".join(x) for x in (words, near, far)]
    five = [grams(t, 5) for t in texts]
    assert share(five[0], five[1]) >= 80 > share(five[0], five[2]) and share(five[1], five[2]) < 80
    assert share(shingles(texts[0]), shingles(texts[1])) < 90
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("lang", "source")], F.length("text").cast("long").alias("n_chars"))
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    own = parity_join.similarity_classes(docs)
    assert {r["component_id"] for r in own.collect()} == {0, 1, 2}


def kept_lines(spark, path, rows):
    """The query's rows by id, with the text that its hash stands for found among ``rows``' expected ones."""
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["kept_sha256"]) for r in line_dedup.op9_line_dedup(spark, str(path)).collect()}


def expected(before, after):
    n = len(before.split("\n"))
    return n, n - (len(after.split("\n")) if after is not None else 0), hashlib.sha256((after or "").encode()).hexdigest()


def test_short_lines_repeat_too(spark, tmp_path):
    rows = [
        (1, "All rights reserved.\n\nla la la la la la\none two three four"),
        (2, "own words\nALL  rights reserved.\n\nla\n\t"),
        (3, "reserved. all Rights\nown words here\none two six\nall rights"),
        (4, "four three two one"),
    ]
    want = [rows[0][1], "own words\n\n\t", "own words here\none two six\nall rights", None]
    got = kept_lines(spark, tmp_path, rows)
    assert got == {i: expected(t, w) for (i, t), w in zip(rows, want, strict=True)}
    columns = ("lang", "source")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", *[F.lit("en").alias(c) for c in columns], F.length("text").cast("long").alias("n_chars"))
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()} == dict(zip((1, 2, 3), want, strict=False))


def test_lines_match_from_80_on(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 100").collect()]
    line = " ".join(f"w{i}" for i in range(20))
    rows += [(1000, f"{line}\np q r s"), (1001, line.replace("w3 ", "z3 ").replace("w9 ", "z9 ")), (1002, "p q r s t\np q r\np q r t u v"), (1003, "p q r s t u")]
    seen, want, between = [], {}, 0
    for i, text in sorted(rows):
        kept = []
        for x in text.split("\n"):
            s = frozenset(WORD.findall(x.lower()))
            best = max((100 * len(s & o) / len(s | o) for o in seen), default=0) if s else 0
            between += 80 <= best < 90
            if best < 80:
                kept.append(x)
            if s:
                seen.append(s)
        want[i] = expected(text, "\n".join(kept) if kept else None)
    got = kept_lines(spark, tmp_path, rows)
    assert between > 1 and got == want
