"""Text functions as column expressions: they stay in the JVM and work on any DataFrame."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words

#: A token: letters, digits, _ and - after a letter or digit, or a run of two or more CJK characters.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-]*|[\x{4e00}-\x{9fff}]{2,}"
#: A run of capitalised words that no letter, digit or _ touches.
ENTITY = r"(?<![\p{L}\p{N}_])[A-Z][A-Za-z0-9_\-]*(?:\s+[A-Z][A-Za-z0-9_\-]*)*(?:(?<=-)(?=[\p{L}\p{N}_])|(?<!-)(?![\p{L}\p{N}_]))"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, without stop words and single characters."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(words.STOPWORDS))


def top_tokens(toks: Column, limit: int) -> Column:
    """The most frequent tokens of a short array, those that come first of equals: its sorted tokens, counted run by run. For long texts use keywords()."""
    kind = "array<struct<c:int,p:int,t:string>>"
    entry = lambda s: F.array(F.struct((-s["c"]).alias("c"), s["p"].alias("p"), s["t"].alias("t")))
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(0).alias("c"), F.lit(0).alias("p"), F.lit("").alias("t"))

    def add(s: Column, x: Column) -> Column:
        again = F.struct(s["out"].alias("out"), (s["c"] + 1).alias("c"), s["p"].alias("p"), s["t"].alias("t"))
        fresh = F.struct(F.concat(s["out"], entry(s)).alias("out"), F.lit(1).alias("c"), x["p"].alias("p"), x["t"].alias("t"))
        return F.when(x["t"] == s["t"], again).otherwise(fresh)

    placed = F.array_sort(F.transform(toks, lambda t, i: F.struct(F.coalesce(t, F.lit("")).alias("t"), i.alias("p"))))
    counted = F.aggregate(placed, start, add, lambda s: F.concat(s["out"], entry(s)))
    return F.transform(F.slice(F.array_sort(F.filter(counted, lambda s: s["c"] < 0)), 1, limit), lambda s: s["t"])


def keywords(texts: DataFrame, key: str, text: str, limit: int = 8) -> DataFrame:
    """(key, token, n, rank): the most frequent tokens of each row's text. key must tell rows apart.

    Rows are dealt once by key; both aggregations and the ranking work on that partitioning.
    """
    each = texts.select(F.col(key), F.posexplode(tokens(F.col(text)))).repartition(key)
    counts = each.groupBy(key, "col").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, F.col("col").alias("token"), "n", "rank")


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(value.cast("string").cast("binary")), 1, 16))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Share of the left set that the right has; 0 if either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_distinct(left)))


def jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def surface_entities(text: Column, limit: int = 8) -> Column:
    """Runs of capitalised words, in order of first occurrence, but for question words."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENTITY), F.lit(0)))
    return F.slice(F.filter(found, lambda e: ~F.lower(e).isin(words.QUESTION_WORDS)), 1, limit)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_lines(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: strip(x)), lambda x: x != ""), "\n")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters that overlap, of the cleaned text: an array of (chunk number, text)."""
    step, clean = max(1, size - overlap), clean_lines(text)
    starts = F.when(F.length(clean) > 0, F.sequence(F.lit(0), F.length(clean) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: strip(F.substring(clean, s + 1, F.lit(size))))
    return F.filter(parts, lambda c: c != "")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " "))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end that white space follows."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(clean.rlike(r"[。！？.!?]\s"), F.regexp_extract(clean, r"^(.*?[。！？.!?])\s", 1)).otherwise(clean)


def compact(text: Column, limit: int) -> Column:
    """White space collapsed; an ellipsis where it is cut."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("…")))


def safe_segment(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    return F.regexp_replace(clean, "^_+|_+$", "")


def entity_name(name: Column) -> Column:
    """The canonical name of an entity: its keywords joined by _, or else its trimmed lower case."""
    joined = F.array_join(top_tokens(tokens(F.regexp_replace(name, "_", " ")), 16), "_")
    return F.when(joined != "", joined).otherwise(F.lower(F.trim(name)))


def answer_terms(text: Column) -> Column:
    found = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " +")
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(words.ANSWER_STOPWORDS)))


def term_coverage(gold: Column, haystack: Column) -> Column:
    """Share of the gold answer's terms that occur in the lower-cased haystack; 0 with under two terms."""
    held = F.array(F.struct(answer_terms(gold).alias("terms"), haystack.alias("text")))  # bound by a lambda, so that neither is made anew for each term
    share = lambda s: F.when(F.size(s["terms"]) < 2, F.lit(0.0)).otherwise(F.size(F.filter(s["terms"], lambda t: F.contains(s["text"], t))) / F.size(s["terms"]))
    return F.transform(held, share)[0]


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def half_up(x: float, digits: int) -> float:
    """F.round() of one number."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def json_object(answer: Column) -> Column:
    """The JSON text from the first opening to the last closing brace, whatever fence or prose stands around it; empty without one."""
    return F.regexp_extract(answer, r"(?s)\{.*\}", 0)
