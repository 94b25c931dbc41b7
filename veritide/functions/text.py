"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are dropped, and words that never are.
STOPWORDS = (
    "a an and are as at be been by for from has have in is it of on or that the this to was were will with"
).split()
NEGATIONS = "not no nor without against".split()

# Place names of the geographic query tag.
GEOGRAPHIC_TERMS = [
    "africa", "antarctic", "antarctica", "arctic", "asia", "australia", "canada", "china", "europe", "global", "greenland",
    "india", "ocean", "pacific", "region", "russia", "uk", "united kingdom", "united states", "us",
]

# Patterns of secrets and of local paths.
SECRET_PATTERNS = {
    "private_key": r"-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "assigned_secret": r"(?i)\b(?:api[_-]?key|access[_-]?token|secret)\s*[:=]\s*['\"][^'\"]+",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{20,}",
    "local_path": r"(^|[^A-Za-z])[A-Za-z]:[\\/]|/data/gpfs/|/home/",
}


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-cased ASCII word tokens of two characters or more, without stopwords; carbon dioxide and CO2 are one token.

    Runs of letters and digits of any script are cut first, so that a word with a letter outside
    ASCII is dropped whole, on every regex engine alike.
    """
    t = F.regexp_replace(F.lower(text), r"\bcarbon\s+dioxide\b", "carbon_dioxide")
    t = F.regexp_replace(t, r"\bco\s*2\b", "carbon_dioxide")
    blocked = [w for w in stopwords if w not in NEGATIONS]
    return F.filter(
        F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)),
        lambda w: w.rlike("^[a-z0-9_]{2,}$") & ~w.isin(blocked),
    )


def alnum_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def normalised(text: Column) -> Column:
    """Runs of a-z and 0-9, joined by one space."""
    return F.array_join(alnum_tokens(text), " ")


def collapsed(text: Column) -> Column:
    """White space runs as one space, trimmed; case kept."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def number_tokens(toks: Column) -> Column:
    return F.array_distinct(F.filter(toks, lambda w: w.rlike("[0-9]")))


def year_tokens(toks: Column) -> Column:
    return F.array_distinct(F.filter(toks, lambda w: w.rlike("^[0-9]{4}$")))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Share of the left set that the right one has; 0 if the left one is empty."""
    n = F.size(F.array_distinct(left))
    return F.when(n > 0, F.size(F.array_intersect(left, right)) / n).otherwise(F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    either = F.size(F.array_union(left, right))
    return F.when(either > 0, F.size(F.array_intersect(left, right)) / either).otherwise(F.lit(0.0))


def constraints(text: Column) -> Column:
    """years, numbers and capitalised runs (12 at most), each sorted and distinct."""

    def found(pattern: str) -> Column:
        return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))

    return F.struct(
        found(r"\b(?:18|19|20|21)\d{2}\b").alias("years"),
        found(r"(?<!\w)[+-]?\d+(?:\.\d+)?%?").alias("numbers"),
        F.slice(found(r"\b[A-Z][A-Za-z-]{2,}(?:\s+[A-Z][A-Za-z-]{2,})*"), 1, 12).alias("entities"),
    )


def decomposed(text: Column, max_queries: int = 2) -> Column:
    """Parts of a claim between conjunctions and semicolons with four tokens or more, the first few."""
    whole = collapsed(text)
    parts = F.transform(F.split(whole, r"(?i)\b(?:and|while|whereas|because|but)\b|[;]"), lambda p: F.btrim(p, F.lit(" ,;:-")))
    useful = F.filter(parts, lambda p: (p != "") & (p != whole) & (F.size(tokens(p)) >= 4))
    return F.slice(useful, 1, max_queries)


def has_spelling_variant(left: Column, right: Column) -> Column:
    """Some word that only one side has is one edit from a word that only the other has; five letters, same first."""
    only_left = F.filter(F.array_except(left, right), lambda w: F.length(w) >= 5)
    only_right = F.filter(F.array_except(right, left), lambda w: F.length(w) >= 5)
    return F.exists(
        only_left,
        lambda x: F.exists(only_right, lambda y: (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.levenshtein(x, y, 1) == 1)),
    )


def hash_fraction(text: Column) -> Column:
    """First eight bytes of SHA-256 as an unsigned number (decimal)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_fold(identifier: Column, folds: int) -> Column:
    return (hash_fraction(identifier.cast("string")) % F.lit(folds)).cast("int")


def in_hash_share(identifier: Column, share: float, seed: int) -> Column:
    """Whether seed:id hashes into the first ``share`` of the range."""
    value = hash_fraction(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))
    return value.cast("double") / F.lit(18446744073709551616.0) < share


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / F.lit(temperature)))
    return F.transform(scaled, lambda x: x / F.aggregate(scaled, F.lit(0.0), lambda a, b: a + b))


def l2_normalised(vector: Column) -> Column:
    """A vector over its Euclidean length, or over the smallest float step if shorter."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1.1920928955078125e-07)))


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
