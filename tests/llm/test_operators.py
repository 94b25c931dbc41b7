"""Each operator against a brute-force version or a library, and on odd inputs."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from veritide.llm import (
    decontaminate, html_main, interpolated_lm, language_id, line_dedup, parity_join, piece_codec, quality_rules, suffix_dedup, url_filter,
)

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A part of the documents with odd rows: nulls, empty and repeated ones, near copies."""
    random.seed(3)
    base = " ".join(f"w{i}" for i in range(90))
    odd = [(-1, None), (-2, ""), (-3, "a b"), (-4, "A  B"), (-5, "Und " * 60), (-6, "é" * 120), (None, "x y z u v w\nx y z u v w"), (-7, "7 8 9!"), (-8, "\n\n \t")]
    for k in range(24):
        words = base.split()
        for _ in range(k % 5):
            words[random.randrange(len(words))] = f"z{random.randrange(40)}"
        odd.append((-100 - k, " ".join(words[:45]) + "\n" + " ".join(words[45:])))
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", "text")
    all_rows = some.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    all_rows = all_rows.unionByName(all_rows.where("doc_id in (3, -103)"))
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    all_rows.withColumn("id", F.lit("clash")).withColumn("token", F.lit(1)).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


# -- 1 --------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    out = language_id.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert held and sum(r["ok"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_id_odd_texts(spark, docs):
    profiles = language_id.learn_profiles(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert set(profiles) == {"en", "de"}
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(docs, profiles, keep=["doc_id", "id"]).collect()}
    assert (-1, "und") in found and (-2, "und") in found and (-8, "und") in found
    assert language_id.identify(docs.limit(0), profiles, keep=["doc_id"]).count() == 0
    assert language_id.Profiles({}).judge("word") == ("und", 0.0)


def test_ngram_codes_are_exact():
    assert len(language_id.ngram_codes("ab")) == 2 + 3 + 2  # a b; _a ab b_; _ab ab_
    assert len(language_id.ngram_codes("12 ?")) == 0


# -- 2 --------------------------------------------------------------------------------------


def test_suffix_dedup_matches_brute_force(docs):
    got = Counter((r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen, want_of = set(), {}
    for i, t in sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want_of[(i, t)] = (i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    assert got == Counter(want_of[x] for x in texts)
    assert sum(x[2] for x in got) > 1000


def test_merged_transforms_order_rotations():
    random.seed(9)
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(20, 60))) for _ in range(12)]
    r = suffix_dedup.Rotations(texts)
    grams = r.gram_ranks()
    import numpy as np

    orders = [suffix_dedup.shard_order(r, grams, np.flatnonzero(r.owner % 3 == s)) for s in range(3)]
    rotation, block = suffix_dedup.merged_blocks(orders, grams[r.moved(-10)], 2)
    whole = [t + b"\0" for t in texts]
    first = [(whole[r.owner[k]] * 3)[r.place[k] :][:20] for k in rotation.tolist()]
    assert first == sorted(first)
    assert all((a == b) == (x == y) for a, b, x, y in zip(first, first[1:], block.tolist(), block.tolist()[1:], strict=False))


def test_suffix_dedup_empty(docs):
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


# -- 3 --------------------------------------------------------------------------------------


def base_statistics(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    inside = {k for i, g in enumerate(grams) if count[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_base_statistics(docs):
    out = quality_rules.judge(docs, [], keep=["doc_id"])
    got = Counter(rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    want = Counter()
    for r in docs.collect():
        s = base_statistics(r["text"])
        bad = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want[(r["doc_id"], *s, bad, not bad)] += 1
    assert got == want


def test_quality_rules_learn_and_stay_native(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.fit_rules(docs, labels)
    out = quality_rules.judge(docs, rules, keep=["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    judged = out.join(labels, "doc_id").where("quality = 1 and not base_failed").collect()
    assert all(r["kept"] for r in judged)
    assert quality_rules.fit_rules(docs, labels.limit(0)) == []


def test_sequential_covering_finds_planted_rule():
    import numpy as np

    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    rules = quality_rules.learn_list(x, bad, part=rng.random(3000) < 0.67)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= r.matches(x)
    assert (hit == bad).mean() > 0.97


# -- 4 --------------------------------------------------------------------------------------


def test_main_text_of_pages(spark):
    for r in html_main.op4_html_main(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_main_text_drops_what_is_not_article(spark):
    page = (
        "<body><header>Site</header><nav>Menu</nav><div class='cookie-notice'>OK?</div><main><h1>Title &amp; more</h1><p>One<br>two <b>three</b><p>Four"
        "<form><input>Search</form><div id=comments><p>First!</div></main><aside>Side</aside><script>x='</p>'</script><footer>Foot</footer>"
    )
    rows = [(1, "http://a.b/x", page), (2, None, None), (3, "nohost", ""), (4, "http://a.b/y", "<p>5 &lt; 6 &#8364; &am"), (4, "http://a.b/y", "<p>5 &lt; 6 &#8364; &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = Counter(rows_of(html_main.extract(pages), "page_id", "text", "n_chars"))
    text = "Title & more\n\nOne two three\n\nFour"
    assert got == Counter({(1, text, len(text)): 1, (2, "", 0): 1, (3, "", 0): 1, (4, "5 < 6 € &am", 11): 2})
    assert html_main.extract(pages.limit(0)).count() == 0


def test_style_tree_removes_boilerplate_and_joins_alike(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><div class=top><p>Same words on every page</div><div class=text><p>Page {i} says {i * 7}<p>and {i * 3}</div>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, 0):  # both ways of bringing the tree to the pages
        got = dict(rows_of(html_main.extract(pages, broadcast_nodes=limit), "page_id", "text"))
        assert got == {i: f"Page {i} says {i * 7}\n\nand {i * 3}" for i in range(40)}


def plain_tree(pages):
    """The merged tree by dictionaries: (path of style, place and label) to importance, for nodes of several pages."""
    styles, texts, counts = defaultdict(list), defaultdict(list), Counter()
    for page in pages:
        nodes, blocks = html_main.parse(page)
        path = [()]
        for n in nodes[1:]:
            path.append((*path[n.parent], tuple(nodes[n.parent].children), n.index, n.label))
        for k, n in enumerate(nodes):
            if n.prior:
                counts[path[k]] += 1
                styles[path[k]].append(tuple(n.children))
        for i, t in {(i, t) for i, t in blocks if nodes[i].prior}:
            texts[path[i]].append(t)
    out = {}
    for k, m in counts.items():
        if m > 1:
            drawn, share = 1 - 1 / m, [n / m for n in Counter(styles[k]).values()]
            entropy = -sum(p * math.log(p, m) for p in share)
            own = [math.log(n, m) for n in Counter(texts[k]).values()]
            out[k] = (m, len(share), 1 - drawn * (1 - entropy), 1 - drawn * sum(own) / len(own) if own else None)
    return sorted(out.values(), key=str)


def test_style_tree_matches_dictionaries(spark):
    random.seed(4)
    pages = []
    for i in range(30):
        body = "".join(random.choice((f"<p>own {i} {k}</p>", "<p>shared</p>", "<div class=x><h2>Head</h2><p>in</p></div>")) for k in range(random.randint(1, 3)))
        pages.append(f"<body><div class=top><p>Same</div><div id=content>{body}</div><footer>f</footer>")
    rows = [(i, f"http://a.b/{i}", p) for i, p in enumerate(pages)]
    tree = html_main.style_tree(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    rounded = lambda t: sorted([tuple(None if x is None else round(x, 9) for x in r) for r in t], key=str)
    assert rounded([(r["pages"], r["styles"], r["presentation"], r["content"]) for r in tree]) == rounded(plain_tree(pages))
    assert all(0 <= r["presentation"] <= 1 and 0 <= (r["content"] or 0) <= 1 for r in tree) and len(tree) > 5


def test_pages_without_marks_and_with_odd_classes(spark):
    prose = lambda i: f"<p>Paragraph {i} with its own words {i * 13}.</p><p>Another one, {i}.</p>"
    made = {
        1: ("<body class='single no-sidebar'><div>" + prose(1) + "</div></body>", "Paragraph 1 with its own words 13.\n\nAnother one, 1."),
        2: ("<body><article><p>Price text that is long enough.</p><div class='share-price related'>Shares rose.</div></article>", "Price text that is long enough.\n\nShares rose."),
        3: ("<body><div id=content>" + prose(3) * 3 + "</div><article>Teaser</article>", "\n\n".join(["Paragraph 3 with its own words 39.\n\nAnother one, 3."] * 3 + ["Teaser"])),
        4: ("<body><article><p>Long article text.</p><section class=comments><p>First!</p></section></article><div>Other</div>", "Long article text."),
        5: ("<body><div class='cookie-banner'>OK?</div><div class='site-footer'>F</div><div class=story>" + prose(5) + "</div>", "Paragraph 5 with its own words 65.\n\nAnother one, 5."),
    }
    rows = [(i, f"http://h{i}.b/", page) for i, (page, _) in made.items()]
    rows += [(100 + i, f"http://many.b/{i}", f"<body><div><p>All pages of this site say so.</p></div><div>{prose(i)}</div>") for i in range(12)]
    got = dict(rows_of(html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "text"))
    assert {i: got[i] for i in made} == {i: t for i, (_, t) in made.items()}
    assert all(got[100 + i] == f"Paragraph {i} with its own words {i * 13}.\n\nAnother one, {i}." for i in range(12))


# -- 5 --------------------------------------------------------------------------------------


def test_piece_codec_equals_library(docs):
    import sentencepiece

    path = piece_codec.default_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = piece_codec.model_at(path)
    random.seed(0)
    texts = [r["text"] for r in docs.collect()] + ["", " ", "  a", "\n", "▁▁a b", "x" * 300, "<s></s><unk><0x41>", "日本語 😀😀 ", "\x00\x01", "a\r\nb\t\tc"]
    texts += ["".join(random.choice("abcdeth  \n▁éß😀日<>0x4\t.,") for _ in range(random.randint(0, 150))) for _ in range(150)]
    for t, (ids, decoded) in zip(texts, model.encode_many(texts), strict=True):
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert model.encode(t) == want and len(ids) == 4 * len(want)
        assert decoded == lib.decode(want) == model.decode(want)


def test_piece_codec_frames(docs):
    out = piece_codec.encode_texts(docs, piece_codec.default_model(), keep=["doc_id", "id"])
    assert out.count() == docs.count()
    assert out.where("doc_id = -1").first()["ids"] == [1, 2]


def test_long_words_take_seconds():
    import time

    import sentencepiece

    random.seed(9)
    path = piece_codec.default_model()
    model, library = piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(random.choices(abc, k=n)) for abc, n in ((letters, 60_000), ("abcdefghijklmnopqrstuvwxyz", 60_000), ("ab", 5_000), ("e", 3_000), ("ñ€x😀", 2_000))]
    for t in texts:
        assert model.encode(t) == library.encode(t, add_bos=True, add_eos=True)
    began = time.perf_counter()
    model.encode("".join(random.choices(letters, k=1 << 20)))
    assert time.perf_counter() - began < 60


def test_remembered_words_are_bounded():
    import tracemalloc

    import sentencepiece

    random.seed(5)
    path = piece_codec.default_model()
    model, library = piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    often = [f"{k}ñ word{k % 89}" for k in range(500)] + ["😀▁\ud800x"]
    tracemalloc.start()
    for _ in range(12):
        fresh = [" ".join("".join(random.choices("abcdefghijklmnopqrst", k=8)) for _ in range(300)) for _ in range(128)]
        found = model.encode_many(often + fresh)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 << 20  # remembering 400,000 words and merging all new ones at once took 132 MB
    for t, (ids, decoded) in list(zip(often + fresh, found, strict=True))[::50]:
        if "\ud800" in t:
            assert decoded == "😀 \ufffd\ufffd\ufffdx"
        else:
            want = library.encode(t, add_bos=True, add_eos=True)
            assert list(memoryview(ids).cast("I")) == want and decoded == library.decode(want)


# -- 6 --------------------------------------------------------------------------------------


def test_url_filter_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?q", "https://net/", "https://net", "ftp://x.net#f", "http://example.com/de/1", "http://b.example.com/fr/1",
        "http://x.org/fr/", "http://xorg/fr/", "no scheme", None, "http://example.net/en", "http://example.net/en/", "://net/a",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = url_filter.rules_frame(spark, url_filter.CONTRACT_RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = low(host)
        fits = [(h + p, v) for h, p, v in url_filter.CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")
        assert got[i] == (host, path, rule, verdict)
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# -- 7 --------------------------------------------------------------------------------------


def shingles(t, size=3):
    w = WORD.findall(low(t or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(zip(*(w[i:] for i in range(size)), strict=False))


def components_of(sets, linked):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_similarity_classes_match_brute_force(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in texts]
    roots = components_of(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    least = defaultdict(lambda: math.inf)
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min(least[r], math.inf if i is None else i)
    want = Counter((i, len(s), None if i is None else least[r]) for (i, _), s, r in zip(texts, sets, roots, strict=True))
    got = Counter(rows_of(parity_join.similarity_classes(docs), "doc_id", "n_shingles", "component_id"))
    assert got == want
    assert len({c for _, _, c in got}) < len(texts) - 10


def test_sketch_distance_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(100, 200)], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
        far = int(np.bitwise_count(parity_join.sketch(a, 9) ^ parity_join.sketch(b, 9)).sum())
        assert far <= len(np.setxor1d(a, b))


def test_bands_cover_all_linkable_sizes():
    bands = parity_join.Bands(90)
    for x in range(1, 400):
        for y in range(x, 400):
            if 100 * x >= 90 * y:
                b, c = bands.band(x), bands.band(y)
                assert c in (b, b + 1) and (x + y) * 10 // 190 <= bands.apart(b)


def test_rows_that_share_an_id_link_by_their_own_texts(spark):
    base, other = (" ".join(f"{c}{i}" for i in range(80)) for c in "wq")
    rows = [(1, base), (1, other), (3, other + " y"), (5, base + " x"), (3, "alone in this text"), (3, "alone in this text"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rest", F.lit(7)).withColumn("hash", F.lit(8)).withColumn("id", F.lit(9))
    got = Counter((r["doc_id"], r["component_id"]) for r in parity_join.similarity_classes(docs).collect())
    assert got == Counter({(1, 1): 2, (3, 1): 1, (5, 1): 1, (3, 3): 2, (None, None): 1})
    kept = parity_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(rows_of(kept, "doc_id", "text", "rest", "hash", "id")) == Counter([(*r, 7, 8, 9) for r in rows if r[0] in (1, None) or r[1].startswith("alone")])


def test_large_open_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    random.seed(5)
    texts = []
    for k in range(60):
        words = [f"w{i}" for i in range(120)]
        for _ in range(k % 7):
            words[random.randrange(120)] = f"z{random.randrange(9)}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in parity_join.similarity_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [shingles(t) for t in texts]
    roots = components_of(sets, lambda a, b: 100 * len(a & b) >= 90 * len(a | b))
    assert all((got[i] == got[j]) == (roots[i] == roots[j]) for i in range(60) for j in range(60))


def test_linked_sets_share_a_part():
    import numpy as np

    rng = np.random.default_rng(3)
    for percent in (80, 90):
        linked = 0
        for _ in range(3000):
            n = int(rng.integers(4, 120))
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop, more = int(rng.integers(0, n // 8 + 2)), int(rng.integers(0, n // 8 + 2))
            y = np.concatenate([x[drop:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
            both, either = n - drop, n + more
            if len(y) and 100 * both >= percent * either and (drop or more):
                linked += 1
                keys = [set(parity_join.part_keys(np.sort(z), parity_join.Bands(percent)).tolist()) for z in (x, y)]
                assert keys[0] & keys[1]
        assert linked > 300


# -- 8 --------------------------------------------------------------------------------------


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_within_the_edit_budget(spark):
    random.seed(7)
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(30).collect()]
    norm = lambda t: decontaminate.normalised(t)[0].tobytes().decode("utf-32-le")
    hits = 0
    for k in range(40):
        item = items[k % 30][: random.choice([40, 90, 250])]
        s = list(item.lower())
        for _ in range(random.randint(0, int(0.14 * len(s)))):
            at = random.randrange(len(s))
            s[at : at + 1] = random.choice([["q"], [], ["z", s[at]]])
        text = docs[k][:150] + " " + "".join(s) + " " + docs[k + 10][:150]
        index = decontaminate.ItemIndex([(1, item)])
        best = edits(norm(item), norm(text))
        found = index.scan([text])
        assert bool(found) == (best <= len(norm(item)) // 10)
        if found:
            hits += 1
            assert min(x[4] for x in found) == best
    assert hits > 10


def test_passages_in_frames(spark, docs):
    items = spark.createDataFrame([(5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (6, None), (7, "?!"), (None, "w1 w2 w3 w4 w5")], "item_id long, text string")
    out = decontaminate.find_passages(docs, items)
    assert {r["item_id"] for r in out.collect()} == {5}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.where("edits = 0").collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"
    assert decontaminate.find_passages(docs, items.limit(0)).count() == 0
    kept = decontaminate.clean(docs, items)
    assert kept.where("doc_id is null").count() == 1 and kept.columns == docs.columns
    blocks = decontaminate.find_passages(docs, items, block_chars=1)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, out.collect()))


def test_every_item_length_has_its_whole_budget():
    random.seed(11)
    found = missed = 0
    for m in [*range(1, 61)] * 3:
        item = "".join(random.choice("abcdefghij") for _ in range(m))
        budget = m // 10
        s = list(item)
        for _ in range(random.randint(0, budget + 1)):
            at = random.randrange(len(s) + 1)
            s[at : at + random.randint(0, 1)] = [random.choice("klmnop")] * random.randint(0, 1)
        text = "".join(random.choice("qrstuvwxyz") for _ in range(40)) + "".join(s) + "".join(random.choice("qrstuvwxyz") for _ in range(40))
        near = edits(item, text) <= budget
        got = decontaminate.ItemIndex([(1, item)]).scan([text])
        assert bool(got) == near, (m, item, "".join(s))
        assert all(e == edits(item, text) for *_, e in got)
        found, missed = found + near, missed + (not near)
    assert found > 60 and missed > 10


def test_short_items_match_each_time():
    index = decontaminate.ItemIndex([(1, "ab"), (2, "c")])
    assert [x[1:4] for x in index.scan(["abab c cab"])] == [(0, 0, 2), (0, 2, 4), (0, 8, 10), (1, 5, 6), (1, 7, 8)]


def test_passages_across_chunk_borders(monkeypatch):
    item = "a passage of some fifty characters that is looked for"
    text = "x" * ((1 << 20) - 20) + " " + item + " " + "y" * (1 << 20) + " " + item.replace("some", "sane")
    got = decontaminate.ItemIndex([(1, item)]).scan([text])
    assert [(text[a:b], e) for _, _, a, b, e in got] == [(item, 0), (item.replace("some", "sane"), 2)]


# -- 9 --------------------------------------------------------------------------------------


def test_line_dedup_matches_brute_force(docs):
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    places = sorted({x for x in texts if x[0] is not None and x[1] is not None})
    seen, gone = [], set()
    for i, t in places:
        for k, line in enumerate(t.split("\n")):
            s = frozenset(WORD.findall(line.lower()))
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    gone.add((i, t, k))
                seen.append(s)
    want = Counter()
    for i, t in texts:
        lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(lines) if (i, t, k) not in gone]
        want[(i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    out = line_dedup.dedup_lines(docs)
    assert Counter(rows_of(out, "doc_id", "text", "n_lines", "n_removed_lines")) == want
    assert gone and out.columns[: len(docs.columns)] == docs.columns


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_frequent_words_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)
    monkeypatch.setattr(line_dedup, "SMALL_BYTES", -1)
    random.seed(12)
    rows = []
    for i in range(60):
        words = [f"c{k}" for k in range(12)]
        for _ in range(random.randint(0, 4)):
            words[random.randrange(12)] = f"r{random.randrange(6)}"
        rows.append((i, " ".join(words) + ("\n" if i % 9 == 0 else "") + ("a b" if i % 2 else "")))
    seen, want = [], {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            w = frozenset(x.split())
            if not w or not any(100 * len(w & o) >= 80 * len(w | o) for o in seen):
                kept.append(x)
            if w:
                seen.append(w)
        want[i] = "\n".join(kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__kept", "__hash", "n_lines", "cls", "id", "rest"):
        docs = docs.withColumn(name, F.lit(name))
    out = line_dedup.dedup_lines(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    assert {i: r["text"] for i, r in got.items()} == want
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_removed_lines"] and got[0]["__hash"] == "__hash" and got[0]["n_lines"] == 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_copies_are_not_paired_with_each_other(spark, monkeypatch):
    words, sizes, write = [f"c{k}" for k in range(40)], [], line_dedup.written

    def written(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    rows = [(i, " ".join([*words[: i % 40], f"r{i}", *words[i % 40 + 1 :]])) for i in range(200)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.where("n_removed_lines = 0").collect()} == {0}
    assert max(sizes) < 10 * len(rows)


def test_similar_lines_meet_at_their_first_common_words_alone(spark):
    sides = "x_{0} as y_{0}"
    row = spark.range(1).selectExpr("1L as x_doc", "0 as x_at", "7L as x_cls", "0L as x_w0", "0L as x_w1", "20 as x_n", "explode(sequence(0, 4)) as x_pos")
    both = row.selectExpr("*", "2L as y_doc", *[sides.format(c) for c in ("at", "cls", "w0", "w1", "n", "pos")])
    # 18 common words are needed: the third of 20 is the last that can be the first of so many.
    assert sorted(r["x_pos"] for r in both.where(line_dedup._passes(80)).collect()) == [0, 1, 2]


def test_first_tries_look_up_one_row_a_word(spark, monkeypatch):
    plans, write = [], line_dedup.written

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    classes = line_dedup.line_classes(spark.createDataFrame([(i, f"a b c d e f g h r{i % 3} s{i}") for i in range(9)], "id long, text string"), line_dedup.long_array(spark, [0] * 65536), 80)
    monkeypatch.setattr(line_dedup, "written", written)
    pairs, hot = line_dedup._first_tries(classes, 80)
    assert {(r["x"]["doc"], r["y"]["doc"]) for r in pairs.collect()} >= {(0, k) for k in range(3, 9, 3)} and hot.isEmpty()
    windows = [p for p in plans if "windowspecdefinition" in p]
    assert windows and not any("lag(" in p for p in windows)


def test_matched_classes_are_joined_once(spark, monkeypatch):
    plans, write = [], line_dedup.written

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(line_dedup, "written", written)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    rows = [(i, f"word one two three four five own{i} own{i + 1} own{i + 2}") for i in range(20)]
    line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(p.count("LeftOuter") for p in plans) == 1


def test_smaller_sets_meet_on_fewer_words_of_one_shuffle(spark):
    random.seed(5)
    lines = [" ".join(random.sample([f"w{k}" for k in range(24)], random.randint(10, 22))) for _ in range(150)]
    ranks = line_dedup.long_array(spark, [0] * (1 << line_dedup.RANK_BITS))
    classes = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), ranks, 80)
    rows = line_dedup._prefix_rows(classes)
    met = line_dedup._meet(rows.withColumn("pos", F.when(F.col("doc") % 10 == 9, -1 - F.col("pos")).otherwise(F.col("pos"))), 80)
    got = {(r["x"]["doc"], r["y"]["doc"]) for r in met.collect()}
    sets = [frozenset(x.split()) for x in lines]
    alike = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a != b and 100 * len(a & b) >= 80 * len(a | b)}
    assert {p for p in alike if p[1] % 10 != 9} <= got and len(alike) > 50
    assert all(i < j and j % 10 != 9 for i, j in got)
    plan = met._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert "ReusedExchange" in plan


def test_only_words_of_many_prefixes_are_tried_first(spark, monkeypatch):
    lines = [" ".join([*[f"c{k}" for k in range(40)], f"r{i}"]) for i in range(150)]
    lines += [" ".join([*[f"{i}d{k}" for k in range(40)], f"{i}s{j}"]) for i in range(30) for j in range(2)]
    classes = line_dedup.line_classes(spark.createDataFrame(list(enumerate(lines)), "id long, text string"), line_dedup.long_array(spark, [0] * (1 << line_dedup.RANK_BITS)), 80)
    busy, seen, tries = line_dedup._busy(classes), [], line_dedup._first_tries
    rows = line_dedup._prefix_rows(classes)
    counts = {r["token"]: r["count"] for r in rows.groupBy("token").count().collect()}
    assert {r["token"] for r in rows.where(busy).collect()} == {t for t, n in counts.items() if n > line_dedup.TRIES} != set()
    monkeypatch.setattr(line_dedup, "_first_tries", lambda *a: seen.append(tries(*a)[0].count()) or tries(*a))
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.where("n_removed_lines = 0").collect()) == [0, *range(150, 210, 2)]
    assert 149 <= seen[0] < 150 * 10


def test_word_ranks_stay_out_of_plan_texts(spark, monkeypatch):
    values = [k * k - 5 for k in range(1 << line_dedup.RANK_BITS)]
    ranks = line_dedup.long_array(spark, values)
    some = spark.createDataFrame([(0,), (7,), (len(values) - 1,), (len(values),)], "k int").select(F.get(ranks, F.col("k")).alias("v"))
    assert [r["v"] for r in some.collect()] == [values[0], values[7], values[-1], None]
    sizes, write, keep = [len(some._jdf.queryExecution().toString())], line_dedup.written, line_dedup.rows_of

    def noted(run):
        def noting(df):
            sizes.append(len(df._jdf.queryExecution().toString()))
            return run(df)

        return noting

    monkeypatch.setattr(line_dedup, "written", noted(write))
    monkeypatch.setattr(line_dedup, "rows_of", noted(keep))
    rows = [(0, "a b c d e f\n\nx y"), (1, "g h\n \ni j"), (2, "A b c d e f\nk l\n"), (3, None), (4, "")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes.append(len(out._jdf.queryExecution().toString()))
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed_lines"]) for r in out.collect()}
    assert found == {0: (rows[0][1], 3, 0), 1: (rows[1][1], 3, 0), 2: ("k l\n", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0)}
    assert len(sizes) > 5 and max(sizes) < 200_000


# -- 10 -------------------------------------------------------------------------------------


def test_interpolated_scores_match_dictionaries(spark):
    got = {r["doc_id"]: r for r in interpolated_lm.op10_interpolated_lm(spark, SF).collect()}
    tokens = {r["doc_id"]: [*WORD.findall(low(r["text"] or "")), "</s>"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    part = {i: zlib.crc32(str(i).encode()) % 7 for i in tokens}
    one, two, main, main_two = Counter(), Counter(), Counter(), Counter()
    begins = main_begins = 0
    for i, t in tokens.items():
        if part[i] != 2:
            one.update(t)
            two.update(zip(["<b>", *t], t, strict=False))
            begins += 1
            if part[i]:
                main.update(t)
                main_two.update(zip(["<b>", *t], t, strict=False))
                main_begins += 1
    n, v = sum(one.values()), len(one)
    weights = learned(tokens, part, main, main_two, main_begins)
    for i, t in tokens.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for h, w in zip(["<b>", *t], t, strict=False):
            c = begins if h == "<b>" else one[h]
            l0, l1, l2 = weights[min(math.frexp(c)[1], interpolated_lm.BUCKETS - 1)]
            score += math.log10(l2 * two[(h, w)] / max(c, 1) + l1 * one[w] / n + l0 / (v + 1))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part[i] == 2, len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-7)
    held = [got[i] for i in tokens if part[i] == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def learned(tokens, part, main, main_two, begins):
    import numpy as np

    n, v, rows = sum(main.values()), len(main), []
    for i, t in tokens.items():
        if part[i] == 0:
            for h, w in zip(["<b>", *t], t, strict=False):
                c = begins if h == "<b>" else main[h]
                rows.append((min(math.frexp(c)[1], interpolated_lm.BUCKETS - 1), 1 / (v + 1), main[w] / n, main_two[(h, w)] / max(c, 1)))
    a = np.array(rows)
    bucket, p = a[:, 0].astype(int), a[:, 1:]
    out = np.full((interpolated_lm.BUCKETS, 3), 1 / 3)
    out[0] = (0.5, 0.5, 0)
    prior = out.copy()
    for _ in range(60):
        share = out[bucket] * p
        share /= share.sum(axis=1, keepdims=True)
        total = prior + np.stack([np.bincount(bucket, share[:, k], interpolated_lm.BUCKETS) for k in range(3)], 1)
        out = total / total.sum(axis=1, keepdims=True)
    return out


def test_lm_odd_rows(spark, docs):
    rows = docs.withColumn("part", F.when(F.col("doc_id") < 0, 2).otherwise(F.lit(0)))
    out = interpolated_lm.score(rows, id_col="doc_id", part_col="part")
    assert out.count() == docs.count()
    assert {r["n_tokens"] for r in out.where("doc_id in (-1, -2, -8)").collect()} == {1}
    nothing = interpolated_lm.score(rows.withColumn("part", F.lit(2)), id_col="doc_id", part_col="part").where("doc_id = 1").first()
    assert nothing["train_tokens"] == 0 and nothing["n_known"] == 0 and nothing["score"] <= 0
    assert interpolated_lm.score(rows.limit(0), id_col="doc_id", part_col="part").count() == 0


def test_language_model_answers_take_little_memory():
    import tracemalloc

    import numpy as np

    from veritide.llm import interpolated_lm as lm

    rng = np.random.default_rng(1)
    asked = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 1 << 22, 40_000, dtype=np.uint64) << np.uint64(40))
        asked.append((keys, [rng.integers(0, 5, len(keys)).astype(np.uint32) for _ in range(2)]))
    batch = lm._row([(7, 0, chunk, lm._pack(lm._steps(k), *c)) for chunk, (k, c) in enumerate(asked)])
    size = sum(len(k) for k, _ in asked)
    tracemalloc.start()
    answers = [(r["to"], r["kind"], lm._unpack(r["payload"]) if r["kind"] == 1 else np.frombuffer(r["payload"], np.int64)) for b in lm._answers(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * size  # one merge of all keys took over 80 bytes a key
    all_keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
    totals = [np.bincount(at, weights=np.concatenate([c[q] for _, c in asked])).astype(np.int64) for q in range(2)]
    for to, kind, got in answers[:-1]:
        where = np.searchsorted(all_keys, asked[to][0])
        assert kind == 1 and all((g == t[where]).all() for g, t in zip(got, totals, strict=True))
    assert [to for to, _, _ in answers] == [*range(40), -1]
    assert answers[-1][2].tolist() == [int((totals[0] + totals[1] > 0).sum()), int((totals[0] > 0).sum()), *(int(t.sum()) for t in totals)]
