"""Quality rules: base statistics of a text, and learned decision lists over them.

Everything that touches rows is a DataFrame expression. A decision list is learned on the
driver by sequential covering from a bounded sample of labelled rows (``SAMPLE_ROWS``): each
rule is a conjunction of thresholds, grown by information gain on one part of the sample,
pruned on the other, and kept if it is precise there. The list becomes one ordered
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, drop, let, read, rows_of, written

#: Largest number of labelled rows that a list is learned from, chosen by a hash of the id.
SAMPLE_ROWS = 20_000

#: Statistics that rules may use, besides the base ones.
FEATURES = (
    "n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate",
    "distinct_rate", "words_per_line", "bang_rate", "bar_rate", "digit_rate", "stop_rate",
)

WINDOW = 3


def words_of(text: Column) -> Column:
    """Runs of other characters than blanks; an empty array for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text has twice or more.

    Windows are sorted by their hash next to their position, so that equal ones become
    neighbours; a text costs n log n.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        keyed = F.sort_array(
            F.transform(
                F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
            )
        )

        def covered(s: Column) -> Column:
            m = F.greatest(F.size(s) - 1, F.lit(0))
            both = F.zip_with(
                F.slice(s, 1, m),
                F.slice(s, 2, m),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
            )
            return F.size(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        return let(keyed, covered)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(words, count)).cast("long")


def base_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and raw counts for FEATURES."""
    t = F.coalesce(text, F.lit(""))

    def kept_chars(others: str) -> Column:
        return F.length(F.regexp_replace(t, others, "")).cast("long")

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": kept_chars(f"[{BLANKS}]+"),
        "n_symbols": kept_chars(r"[^#*$%&|<>]+"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
        "__n_lines": F.size(lines).cast("long"),
        "__n_upper": kept_chars(r"[^A-ZÀ-ÖØ-Þ]+"),
        "__n_bang": kept_chars("[^!?]+"),
        "__n_bar": kept_chars("[^|]+"),
        "__n_digit": kept_chars("[^0-9]+"),
        "__n_distinct": F.size(F.array_distinct("__words")).cast("long"),
        "__n_short": F.size(F.filter("__words", lambda w: F.length(w) <= 3)).cast("long"),
    }


def with_statistics(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with the base statistics, ``base_failed`` and the rates that rules use."""
    rows = docs.select(*keep, F.col(text_col).alias("__text")).withColumn("__words", words_of(F.col("__text")))
    stats = rows.select(*keep, *[c.alias(k) for k, c in base_statistics(F.col("__text")).items()])

    def rate(top: str, bottom: str) -> Column:
        return F.col(top) / F.greatest(F.col(bottom), F.lit(1))

    return stats.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.struct(
            F.col("n_words").cast("double").alias("n_words"),
            rate("word_chars", "n_words").alias("mean_word"),
            rate("n_symbols", "n_words").alias("symbol_rate"),
            rate("n_dup_lines", "__n_lines").alias("dup_line_rate"),
            rate("n_repeat_words", "n_words").alias("repeat_rate"),
            rate("__n_upper", "word_chars").alias("upper_rate"),
            rate("__n_distinct", "n_words").alias("distinct_rate"),
            rate("n_words", "__n_lines").alias("words_per_line"),
            rate("__n_bang", "n_words").alias("bang_rate"),
            rate("__n_bar", "n_words").alias("bar_rate"),
            rate("__n_digit", "word_chars").alias("digit_rate"),
            rate("__n_short", "n_words").alias("stop_rate"),
        ).alias("features"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); it says that a text goes."""

    tests: tuple[tuple[str, str, float], ...]

    def matches(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, way, at in self.tests:
            out &= x[name] <= at if way == "<=" else x[name] > at
        return out

    def column(self, features: str = "features") -> Column:
        out = F.lit(True)
        for name, way, at in self.tests:
            c = F.col(f"{features}.{name}")
            out = out & (c <= F.lit(at) if way == "<=" else c > F.lit(at))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {w} {a:.4g}" for n, w, a in self.tests)


def learn_list(
    x: dict[str, np.ndarray], bad: np.ndarray, *, part: np.ndarray, max_tests: int = 4, max_rules: int = 12,
    edges: int = 64, least_cover: int = 5, precision: float = 0.9,
) -> list[Rule]:
    """Rules for ``bad`` rows by sequential covering.

    ``part`` is True for rows that rules grow on, False for rows that prune and accept them.
    Thresholds are midpoints between quantiles of the growing rows. A rule is accepted if it
    covers ``least_cover`` pruning rows at ``precision``; covering ends with the first that
    doesn't. Too few rows of either class: an empty list.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (bad & left & part).sum() >= least_cover:
        rule = _pruned(_grown(x, bad, left & part, max_tests, edges), x, bad, left & ~part)
        if rule is None:
            break
        hit = rule.matches(x) & left
        judged = hit & ~part
        if judged.sum() < least_cover or bad[judged].mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _grown(x, bad, rows, max_tests, edges) -> list[tuple[str, str, float]]:
    tests: list[tuple[str, str, float]] = []
    inside = rows.copy()
    for _ in range(max_tests):
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        if not p0 or not n0:
            break
        best, found = 0.0, None
        for name, v in x.items():
            own = v[inside]
            q = np.unique(np.quantile(own, np.linspace(0, 1, edges + 1)))
            cuts = (q[:-1] + q[1:]) / 2
            # cumulative class counts below each cut
            good_bad = [np.searchsorted(np.sort(own[mask]), cuts, side="right") for mask in (bad[inside], ~bad[inside])]
            for way, (p, n) in (("<=", good_bad), (">", (p0 - good_bad[0], n0 - good_bad[1]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best + 1e-9:
                    best, found = float(gain[k]), (name, way, float(cuts[k]))
        if found is None:
            break
        tests.append(found)
        inside &= Rule((found,)).matches(x)
    return tests


def _pruned(tests, x, bad, rows) -> Rule | None:
    """The prefix of the tests that is worth most, (p - n) / (p + n), on the pruning rows; the shortest of equals."""
    best, found = 0.0, None
    for k in range(1, len(tests) + 1):
        rule = Rule(tuple(tests[:k]))
        hit = rule.matches(x) & rows
        worth = (2 * bad[hit].mean() - 1) if hit.any() else 0.0
        if worth > best + 1e-9:
            best, found = worth, rule
    return found


def fit_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """A decision list from at most ``sample_rows`` labelled ids (the smallest by hash of the id).

    An id with several labels counts with its lowest; null ids and labels are left out. The
    sample's ids are bounded, so they are broadcast; of an id with several texts one counts.
    """
    sample = (
        labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.min(quality_col).alias("__quality"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(sample_rows)
    )
    # The sample's texts are written first, so that statistics are computed for them alone; of an id's
    # rows the smallest by hash counts, so that the sample is bounded in rows too.
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(sample), "__id")
    one = met.groupBy("__id", "__quality").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))
    rows = written(one)
    got = rows_of(
        with_statistics(rows, keep=["__id", "__quality"], text_col="__t")
        .where("not base_failed")
        .select("__id", "__quality", F.abs(F.xxhash64("__id", F.lit(7))) % 3, *[f"features.{f}" for f in FEATURES])
    )
    drop(rows)
    if not got:
        return []
    got.sort(key=lambda r: (r[0], *r[3:]))
    x = {f: np.array([r[3 + k] for r in got], float) for k, f in enumerate(FEATURES)}
    return learn_list(x, np.array([r[1] == 0 for r in got]), part=np.array([r[2] != 0 for r in got]))


def list_column(rules: list[Rule]) -> Column:
    """The ordered conditional expression: 1-based number of the first rule that fits, else null."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(), F.lit(k)) if out is None else out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(None).cast("int")) if out is not None else F.lit(None).cast("int")


def judge(docs: DataFrame, rules: list[Rule], *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, the base statistics, base_failed, ``kept`` and ``rule`` (the one that fits first).

    A null or empty text has no words: all statistics 0, base_failed true, kept false. Rows are
    judged one by one, so repeated rows, ties and empty tables need no rule; columns other
    than ``keep`` and the text are not read.
    """
    out = with_statistics(docs, keep=keep, text_col=text_col).withColumn("rule", list_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
