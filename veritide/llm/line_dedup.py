"""Line dedup: an exact set-similarity join of lines, by DataFrame functions alone.

A line is a set of words, ordered by rarity. Two lines of Jaccard similarity ``percent`` or
more share a word in their prefixes (the first n - ceil(t n) + 1 words), so lines meet on prefix
words only; of the smaller set, the first n - ceil(2 t n / (1 + t)) + 1 do, as two sets share 2 t / (1 + t) of the smaller
one at least. Length, position and a 128-bit parity sketch (whose Hamming distance never exceeds the
symmetric difference) sift the pairs; Jaccard on the whole word sets decides. A line with an
earlier match goes. Lines of the same set are one class, whose first place alone can stay; sets
too small to be similar to any other set need no prefix.

Skew. Classes are collapsed with partial aggregation before anything meets. Every class first tries
the earliest class of each of its prefix words that may be in more than TRIES prefixes, so a large group of lines that are near
its first one gives a number of pairs in proportion to its lines; a smaller group gives TRIES pairs a line at most.
Classes without a match meet all other classes of their words; those of a word in more than HOT prefixes are dealt into
blocks of HOT. No class is left untried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, drop, estimated_bytes, large_maps, let, long_array, packed, read, rows_of, runtime_filters, unpacked, written

#: Jaccard similarity, in per cent, from which two lines match.
PERCENT = 80

#: Words are ordered by the count of their hash bucket; so many buckets bound that table.
RANK_BITS = 18

#: Classes first try the earliest class of a word whose hash bucket has so many more prefixes than a bucket's mean and a quarter.
TRIES = 100

#: A word in the prefixes of more classes than this is met in two steps, and in blocks of so many classes.
HOT = 1000

#: Places to look up are broadcast if their table takes no more bytes than this; others are shuffled.
SMALL_BYTES = 4 << 20

#: A class: a hash of its tokens, 128 parity bits, and its size.
_CLASS = ("cls", "w0", "w1", "n")

#: Its place and key; classes are in this order.
_PLACE = ("doc", "at", *_CLASS)


def _words(line: Column | str) -> Column:
    """Lower-cased words; the plain split is much the faster one, and most lines have no other blank than spaces."""
    low = F.lower(line)
    other = F.lit(False)
    for blank in "\t\x0b\x0c\r\n":
        other = other | F.contains(F.col(line) if isinstance(line, str) else line, F.lit(blank))
    return F.array_remove(F.when(other, F.split(low, f"[{BLANKS}]+")).otherwise(F.split(low, " ")), "")


def _lines(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, line number, line) of every row with an id and a text."""
    known = rows.where("text is not null and id is not null").select("text", F.col("id").alias("doc"), F.xxhash64("text").alias("text_hash"))
    return known.select("doc", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _ranks(rows: DataFrame) -> Column:
    """Place of each hash bucket by its number of words over all lines, rarest first, as the top bits of a token (a fixed-size array)."""
    words = _lines(rows).select(F.explode(_words("line")).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit((1 << RANK_BITS) - 1)).alias("bucket")).count()
    with large_maps(rows.sparkSession, RANK_BITS + 1):
        order = rows_of(counts.agg(F.sort_array(F.collect_list(F.struct("count", "bucket")))["bucket"].alias("order")))[0][0]
    ranks = [0] * (1 << RANK_BITS)
    for place, bucket in enumerate(order, 1):
        ranks[bucket] = place << (62 - RANK_BITS)
    return long_array(rows.sparkSession, ranks)


def line_classes(rows: DataFrame, ranks: Column, percent: int) -> DataFrame:
    """One row for each distinct word set: its first place, size, sketch and prefix. Written."""
    mask = (1 << RANK_BITS) - 1

    def number(h: Column) -> Column:
        # Never null, so that the tokens are sorted as bare longs.
        place = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(mask)).cast("int")), F.lit(0).cast("long"))
        return place.bitwiseOR(F.shiftrightunsigned(h, RANK_BITS + 2))

    hashes = F.array_distinct(F.transform(_words("line"), lambda w: F.xxhash64(w)))
    # Generators keep the filter from computing a set once more.
    sets = _lines(rows).select("doc", "text_hash", "at", F.explode(F.array(hashes)).alias("hashes")).where(F.size("hashes") > 0)
    sets = sets.select("doc", "text_hash", "at", F.explode(F.array(F.sort_array(F.transform("hashes", number)))).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", 1, n - F.floor((percent * n + 99) / 100).cast("int") + 1)
    parity = [F.expr(f"aggregate(tokens, 0L, (a, x) -> if((x & 64) = {k << 6}, a ^ shiftleft(1L, cast(x & 63 as int)), a))").alias(f"w{k}") for k in range(2)]
    facts = sets.select(
        "doc", "text_hash", "at",
        F.xxhash64("tokens").alias("cls"),
        *parity,
        n.alias("n"),
        # A set that not even one more word leaves similar has no match but equal sets.
        F.when(100 * n >= percent * (n + 1), prefix).otherwise(F.slice("tokens", 1, 0)).alias("prefix"),
    )
    return written(facts.groupBy(*_CLASS).agg(F.min(F.struct("doc", "at", "text_hash", "prefix")).alias("first")).select(*_CLASS, "first.*"))


def _prefix_rows(classes: DataFrame) -> DataFrame:
    """A row (token, doc, at, cls, w0, w1, n, pos) for each prefix word of each class."""
    return classes.select(*_PLACE, F.posexplode("prefix").alias("pos", "token"))


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(c if c in ("token", "block") else f"{name}_{c}") for c in rows.columns])


def _place(side: str) -> Column:
    return F.struct(*[F.col(f"{side}_{c}").alias(c) for c in _PLACE])


def _position(pos: str) -> Column:
    """The position of a prefix word, which is -1 - pos where the class is gone."""
    return F.when(F.col(pos) < 0, -1 - F.col(pos)).otherwise(F.col(pos))


def _near(percent: int) -> Column:
    """Length, position and sketch filters on sides x and y; none of them drops a match."""
    an, bn = F.col("x_n").cast("long"), F.col("y_n").cast("long")
    least = F.floor((percent * (an + bn) + 99 + percent) / (100 + percent)).cast("long")
    # A pair need only pass at its first common word, before which it shares none.
    most = F.least(an - _position("x_pos"), bn - _position("y_pos"))
    apart = F.bit_count(F.col("x_w0").bitwiseXOR(F.col("y_w0"))) + F.bit_count(F.col("x_w1").bitwiseXOR(F.col("y_w1")))
    return (100 * F.least(an, bn) >= percent * F.greatest(an, bn)) & (most >= least) & (apart <= an + bn - 2 * least)


def _passes(percent: int) -> Column:
    """The filters on sides x (the earlier one) and y."""
    return (F.col("x_doc") <= F.col("y_doc")) & _near(percent) & (_place("x") < _place("y"))


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y), the earlier class first, of prefix rows of equal tokens that pass the filters; not those whose later class is gone."""
    # One shuffle for both sides: the partition's number, which no rule can move, keeps the filters of each side above it.
    rows = rows.repartition("token").select("*", F.spark_partition_id().alias("part")).where("part >= 0")
    n = F.col("n").cast("long")
    few = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)).cast("long") + 1
    short = rows.where(_position("pos") < few).drop("part")
    # Side x is the smaller set, or the earlier of two of one size.
    order = (F.col("x_n") <= F.col("y_n")) & ((F.col("x_n") < F.col("y_n")) | (_place("x") < _place("y")))
    asks = F.when(_place("x") < _place("y"), F.col("y_pos")).otherwise(F.col("x_pos")) >= 0
    met = _side(short, "x").join(_side(rows.drop("part"), "y"), "token").where(_near(percent) & order & asks)
    return met.select(F.least(_place("x"), _place("y")).alias("x"), F.greatest(_place("x"), _place("y")).alias("y")).distinct()


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(_place("x").alias("x"), _place("y").alias("y")).distinct()


def _judged(pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``ok``: whether the lines' whole word sets are similar enough. Written."""
    spark = pairs.sparkSession
    key = lambda s: F.struct(*[f"{s}.{c}" for c in _CLASS])
    places = pairs.select(F.explode(F.array("x", "y")).alias("p")).distinct().select("p", "p.*").join(classes.select(*_CLASS, "text_hash"), list(_CLASS))
    wanted = written(places.groupBy("doc", "text_hash").agg(F.collect_list(F.struct(F.col("p.at").alias("at"), key("p").alias("key"))).alias("lines")))
    way = "broadcast" if estimated_bytes(wanted) <= SMALL_BYTES else "shuffle_hash"
    with runtime_filters(spark):
        # The filter that is always true lets Spark build its Bloom filter of these ids.
        some = rows.where("text is not null").join(
            wanted.where("size(lines) > 0").hint(way), (F.col("id") == F.col("doc")) & (F.xxhash64("text") == F.col("text_hash"))
        )
        lines = some.select("lines", F.explode(F.array(F.split("text", "\n"))).alias("all")).select("all", F.explode("lines").alias("l"))
        one = lines.select("l.key", F.get("all", F.col("l.at")).alias("line")).dropDuplicates(["key"])
        found = written(one.select("key", F.array_distinct(_words("line")).alias("words")))
    joined = pairs.select("x", "y", key("x").alias("xk"), key("y").alias("yk"))
    for s in "xy":
        joined = joined.join(found.select(F.col("key").alias(f"{s}k"), F.col("words").alias(f"{s}w")), f"{s}k")
    both = F.size(F.array_intersect("xw", "yw"))
    out = written(joined.select("x", "y", (100 * both >= percent * (F.size("xw") + F.size("yw") - both)).alias("ok")))
    drop(wanted, found)
    return out


def _busy(classes: DataFrame) -> Column:
    """Whether ``token``'s hash bucket is in more prefixes than others, by TRIES and a quarter of the mean (a fixed-size bitmap)."""
    buckets = 1 << RANK_BITS
    bucket = F.col("token").bitwiseAND(F.lit(buckets - 1))
    counts = classes.select(F.explode("prefix").alias("token")).groupBy(bucket.alias("bucket")).count()
    every = counts.agg(F.sum("count").alias("total"), F.collect_list(F.struct("count", "bucket")).alias("all"))
    large = F.filter("all", lambda b: b["count"] > min(TRIES, HOT) + 1.25 / buckets * F.col("total"))
    bits = [0] * (buckets >> 6)
    with large_maps(classes.sparkSession, RANK_BITS + 1):
        found = rows_of(every.select(large["bucket"]))[0][0]
    for b in found:
        bits[b >> 6] |= 1 << (b & 63)
    bits = long_array(classes.sparkSession, [x - (1 << 64) if x >> 63 else x for x in bits])
    word = F.get(bits, F.shiftright(bucket, 6).cast("int"))
    return F.getbit(word, bucket.bitwiseAND(F.lit(63)).cast("int")) == 1


def _first_tries(classes: DataFrame, percent: int, busy: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of a class and the earliest class of a prefix word, and (token, blocks) of words in more than HOT prefixes,
    of all words or those that ``busy`` tells. Written."""
    rows = _prefix_rows(classes)
    rows = _side(rows if busy is None else rows.where(busy), "y")
    w = Window.partitionBy("token").orderBy(*[f"y_{c}" for c in _PLACE])
    # Each further row looked up here costs as much as the rest of the step.
    earliest = [F.first(f"y_{c}").over(w).alias(f"x_{c}") for c in (*_PLACE, "pos")]
    rows = rows.select("*", *earliest, F.row_number().over(w).alias("k"))
    full = F.col("k") % HOT == 0
    rows = rows.select("*", F.coalesce(_passes(percent), F.lit(False)).alias("tries")).where(f"tries or k % {HOT} = 0")
    found = written(rows.select("token", "k", full.alias("full"), "tries", _place("x").alias("x"), _place("y").alias("y")))
    pairs = written(found.where("tries").select("x", "y").distinct())
    hot = written(found.where("full").groupBy("token").agg((F.max("k") / HOT).cast("long").alias("blocks")))
    drop(found)
    return pairs, hot


def later_matches(classes: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``classes`` with ``gone`` (true, else null) where a first try is similar, and the other classes (cls, w0, w1, n) that
    have an earlier place with a similar set. Written; the first replaces ``classes``."""
    none = classes.select(*_CLASS).where("false")
    pairs, hot = _first_tries(classes, percent, _busy(classes))
    gone = _with_more(written(none), pairs, classes, rows, percent)
    few = F.broadcast(gone) if estimated_bytes(gone) <= SMALL_BYTES else gone
    # Written, as several readers follow.
    flagged = written(classes.join(few.withColumn("gone", F.lit(True)), list(_CLASS), "left"))
    drop(classes, gone)
    # A class that is gone asks no more: its positions are -1 - pos, so that both sides of the join are one and the same shuffle.
    every = flagged.select(*_PLACE, "gone", F.posexplode("prefix").alias("pos", "token"))
    every = every.withColumn("pos", F.when(F.col("gone"), -1 - F.col("pos")).otherwise(F.col("pos"))).drop("gone")
    any_hot = not hot.isEmpty()
    mild = every.join(F.broadcast(hot) if estimated_bytes(hot) <= SMALL_BYTES else hot, "token", "left_anti") if any_hot else every
    rest = _meet(mild, percent)
    if any_hot:
        found = every.join(hot, "token")
        asks = found.where("pos >= 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("block"))
        held = found.withColumn("block", F.pmod(F.xxhash64(*_CLASS), F.col("blocks") + 1))
        rest = rest.unionByName(_pairs(_side(asks, "y").join(_side(held, "x"), ["token", "block"]).where(_passes(percent)))).distinct()
    rest = written(rest)
    drop(hot)
    return flagged, _with_more(written(flagged.select(*_CLASS).where("false")), rest, flagged, rows, percent)


def _with_more(gone: DataFrame, pairs: DataFrame, classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``gone`` with the later classes of ``pairs`` that match. Replaces both written tables."""
    if pairs.isEmpty():
        drop(pairs)
        return gone
    judged = _judged(pairs, classes, rows, percent)
    out = written(gone.unionByName(judged.where("ok").select(*[f"y.{c}" for c in _CLASS])).distinct())
    drop(gone, pairs, judged)
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with lines removed from the text, and n_lines, n_removed_lines.

    Lines are split at line feeds; words are runs of other characters than blanks, lower-cased.
    A line with a word goes if an earlier line (smaller id, or same id and earlier line; removed ones
    included) has a Jaccard similarity of ``percent`` or more; lines of one to a few words match
    equal sets alone, as any other set is less similar. Lines without a word stay. A null text
    stays null with 0 lines; an empty one has one empty line. Lines of rows with a
    null id are left alone. Rows repeated with id and text count as one place and keep the same lines; rows that
    share an id but not the text are told apart by a hash of the text, and at equal places the
    order is that of the class's hash. Other columns are passed on; input columns named n_lines
    or n_removed_lines are replaced. Classes are told apart by a 64-bit hash, 128 parity bits and the size;
    similar classes are compared word by word.
    """
    rows = packed(docs, id_col, text_col)
    slim = rows.select("id", "text")
    ranks = _ranks(slim)
    classes = line_classes(slim, ranks, percent)
    classes, gone = later_matches(classes, slim, percent)
    stay = classes.where("gone is null").join(gone, list(_CLASS), "left_anti")
    kept = written(stay.groupBy("doc", "text_hash").agg(F.collect_list("at").alias("kept")))
    drop(classes, gone)
    joined = rows.join(kept, (F.col("id") == F.col("doc")) & (F.xxhash64("text") == F.col("text_hash")), "left")

    def parted(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        blank = F.filter(every, lambda i: ~F.rlike(F.get(lines, i), F.lit(f"[^{BLANKS}]")))
        # A text that keeps as many lines as it has keeps all of them.
        whole = F.col("id").isNull() | (F.size("kept") == F.size(lines))
        stay = F.when(whole, every).otherwise(F.array_intersect(every, F.array_union(blank, F.coalesce("kept", F.array().cast("array<int>")))))
        return let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).alias("n"), F.size(s).alias("kept")))

    cut = F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), parted))
    out = joined.select("id", "rest", F.explode(F.array(cut)).alias("cut")).select("id", "cut.text", "rest", "cut.n", "cut.kept")
    n, left = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("kept", F.lit(0)).cast("long")
    return unpacked(out, docs.columns, id_col, text_col, n_lines=n, n_removed_lines=n - left)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
