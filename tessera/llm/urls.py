"""URL filter: rules by host and path, and for what no rule fits a ratio of two character language models.

Rules name a host with its subdomains and the beginning of a path; the longest fitting one decides. The URLs that rules
allow and block are the text of two Markov models over characters. Both are of variable order: a history of `order`
characters falls back, with Witten-Bell weights, on its last order-1, order-2, .. ones and in the end on equal chances. A
URL's score is the difference of its log-likelihoods over its length. One URL in some five that has a rule is kept from the
models; on these the threshold is set, where the share of allowed URLs at or above it exceeds that of blocked ones most: in
the middle of the empty scores below the last of those that are kept.

All is a plan of built-in functions. Counts are of all pages: one table of the distinct (order + 1)-grams with their counts
in either class, from which the shorter ones are sums. It grows with the input and is never sent whole anywhere: each URL
without a rule meets its grams by a join, in which those that make up over a thousandth of all places come by broadcast.
Joins of a gram with its shorter form and sums over a history have at most as many rows a key as there are characters.
Scores are sums of whole numbers (2**-20 nats), so they don't depend on the order of addition.

Defined results: a null url counts as an empty one, of empty host and path, with no rule and the score of the end sign
alone; without URLs of either class all scores are 0, and without held-out URLs of either the threshold is 0; at the
threshold, URLs are allowed. Equal urls get equal verdicts, null and repeated page_ids stay, an empty table gives an empty
one, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import join_split, materialize

#: (verdict, host, beginning of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 5
#: One nat in units of a score, and the width of a bin of scores in the same.
NAT, BIN = 1 << 20, 1 << 14
_FIRST, _LAST = "\x02", "\x03"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule(at: Column, of: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host `at` and path `of`; null if none does."""
    fits = lambda h, p: ((at == h) | at.endswith("." + h)) & of.startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    decided = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in longest]
    return F.coalesce(*decided, F.lit(None).cast("struct<rule:string,verdict:string>"))


def with_rules(pages: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, u (the url, empty for null), host, path, rule, verdict (null where no rule fits)."""
    named = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u"))
    parts = named.select("*", host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    return parts.withColumn("_r", rule(F.col("host"), F.col("path"), rules)).select("page_id", "u", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("verdict"))


def distinct_urls(ruled: DataFrame) -> DataFrame:
    """uid, u, n (pages of it), part: train or test with the rule's verdict, or judge. Stored."""
    held = F.substring(F.md5("u"), 1, 1).isin("0", "1", "2")
    part = F.when(F.col("verdict").isNull(), F.lit("judge")).otherwise(F.concat(F.when(held, F.lit("test ")).otherwise(F.lit("train ")), F.col("verdict")))
    return materialize(ruled.groupBy("u", part.alias("part")).agg(F.count("*").alias("n")).withColumn("uid", F.monotonically_increasing_id()), "urls")


def places(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """uid, part, n, g for each place of each url: the character (last the end sign) with the `order` ones before it."""
    padded = F.concat(F.lit(_FIRST * order), F.col("u"), F.lit(_LAST))
    at = urls.select("uid", "part", "n", padded.alias("_s"), F.explode(F.sequence(F.lit(1), F.length("u") + 1)).alias("_i"))
    return at.select("uid", "part", "n", F.substr("_s", "_i", F.lit(order + 1)).alias("g"))


def gram_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """g, a and r (its places in allowed and blocked training pages), asked (its places in distinct urls to be scored). Stored."""
    of = lambda part, what: F.coalesce(F.sum(F.when(part, what)), F.lit(0)).cast("long")
    p = F.col("part")
    return materialize(places(urls, order).groupBy("g").agg(of(p == "train allow", F.col("n")).alias("a"), of(p == "train block", F.col("n")).alias("r"), of(~p.startswith("train"), F.lit(1)).alias("asked")), "grams")


def smoothed(count: Column, seen: Column, kinds: Column, shorter: Column) -> Column:
    """Witten-Bell: the count in a history seen `seen` times with `kinds` different characters, filled up by the shorter history's chance."""
    return F.when(seen > 0, (count + kinds * shorter) / (seen + kinds)).otherwise(shorter)


def log_ratios(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """g, bits: ln P(character | history) of allowed URLs less that of blocked ones, in whole units of 2**-20, for each gram."""
    levels = [grams.select("g", "a", "r")]
    for _ in range(order):
        levels.insert(0, levels[0].groupBy(F.expr("substr(g, 2)").alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    stats = {"ca": F.sum("a"), "ta": F.count_if(F.col("a") > 0), "cr": F.sum("r"), "tr": F.count_if(F.col("r") > 0)}
    chance = lambda c, p: smoothed(F.col(c), F.col("c" + c), F.col("t" + c), p)
    whole = levels[0].agg(*[s.alias(k) for k, s in stats.items()], (F.lit(1.0) / (F.count("*") + 1)).alias("even"))  # one row
    known = levels[0].crossJoin(F.broadcast(whole)).select("g", chance("a", F.col("even")).alias("pa"), chance("r", F.col("even")).alias("pr"))
    for k in range(1, order + 1):
        history = W.partitionBy(F.substring("g", 1, k))
        counted = levels[k].select("g", "a", "r", *[s.over(history).alias(n) for n, s in stats.items()], F.expr("substr(g, 2)").alias("_s"))
        known = counted.join(known.select(F.col("g").alias("_s"), F.col("pa").alias("_pa"), F.col("pr").alias("_pr")), "_s").select("g", chance("a", F.col("_pa")).alias("pa"), chance("r", F.col("_pr")).alias("pr"))
    return known.select("g", F.round((F.log("pa") - F.log("pr")) * NAT).cast("long").alias("bits"))


def scores(urls: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """uid, score (mean log-ratio of a place, in 2**-20 nats, rounded down) of the urls that are no training text. Stored."""
    rated = materialize(grams.select("g", "asked").where("asked > 0").join(log_ratios(grams, order), "g"), "log-ratios")
    total = rated.agg(F.sum("asked")).first()[0] or 0
    asked = places(urls.where(~F.col("part").startswith("train")), order).select("uid", "g")
    return materialize(join_split(asked, rated, ["g"], "asked", total).groupBy("uid").agg(F.floor(F.sum("bits") / F.count("*")).cast("long").alias("score")), "url-scores")


def threshold(urls: DataFrame, scored: DataFrame) -> DataFrame:
    """One row, `least`: the score from which on URLs are allowed, by the held-out pages that rules decide. Over bins of 1/64 nat, of which there are a few thousand at most."""
    tested = urls.where(F.col("part").startswith("test")).join(scored, "uid").groupBy(F.floor(F.col("score") / BIN).alias("bin"))
    bins = tested.agg(F.sum(F.when(F.col("part") == "test allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("part") == "test block", F.col("n")).otherwise(0)).alias("r"))
    above = W.orderBy(F.desc("bin"))
    ranked = bins.select("bin", F.coalesce(F.lead("bin").over(above) + 1, "bin").alias("end"), F.sum("a").over(above).alias("a"), F.sum("r").over(above).alias("r"), F.sum("a").over(W.partitionBy()).alias("na"), F.sum("r").over(W.partitionBy()).alias("nr")).where("na > 0 and nr > 0")
    best = F.max(F.struct((F.col("a") / F.col("na") - F.col("r") / F.col("nr")).alias("gain"), (-F.col("bin")).alias("low"), "end"))
    return ranked.agg(best.alias("b")).select(F.coalesce((F.col("b.end") - F.col("b.low")) * (BIN // 2), F.lit(0)).cast("long").alias("least"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, log_ratio (nats a character; null where a rule decides), one row a page."""
    ruled = with_rules(pages, rules, url, page_id)
    urls = distinct_urls(ruled)
    scored = scores(urls, gram_counts(urls, order), order)
    asked = urls.where("part = 'judge'")
    least = threshold(urls, scored)  # one row
    ours = materialize(asked.join(scored, "uid").crossJoin(F.broadcast(least)).select("u", "n", "score", F.when(F.col("score") >= F.col("least"), F.lit("allow")).otherwise(F.lit("block")).alias("_v")), "url-verdicts")
    total = ours.agg(F.sum("n")).first()[0] or 0
    cols = ("page_id", "host", "path", "rule")
    decided = ruled.where("verdict is not null").select(*cols, "verdict", F.lit(None).cast("double").alias("log_ratio"))
    return decided.unionByName(join_split(ruled.where("verdict is null").select(*cols, "u"), ours, ["u"], "n", total).select(*cols, F.col("_v").alias("verdict"), (F.col("score") / NAT).alias("log_ratio")))
