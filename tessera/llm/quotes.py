"""Chat formatting by quotation linking.

A line's quote level is the number of > signs before it. Neighbouring lines of one level make a passage; a passage is
normalised (lower case, one blank for any run of white space, so wrapping doesn't matter) and hashed. What a message quotes
at a level are its passages of that level, and each line of theirs; what it says are its own paragraphs, their lines, and all
of them as one. At each level it is linked with the earlier message of its conversation that says most of what it quotes
there (the latest of equals), and it replies to that of the outermost level that is linked. Units meet by hash, and the link
compares their texts.

A unit that at most `RARE` messages of its conversation say leads to each of them. Those that more say are hot: messages that
say the same hot units are one class, as are those that quote the same ones, and only the latest earlier message of a class
is looked up, so that lines which everybody says and quotes make no pairs of messages.

Conversations are put in reply order, each reply after what it answers and before later messages that answer nothing, and
messages keep only what is not quoted. Depths, sizes of subtrees and places come from pointer doubling over the replies:
log2 of the longest chain rounds of joins, with a row a message, however long the chain. Places of messages that answer
nothing are counted over range-partitioned rows, so that one conversation may be split over many tasks.

Defined results: null texts are empty messages; messages without quotes, or whose quotes are found nowhere before, start a
thread; lines of nothing but quote signs link nothing; messages with equal conv_id and turn share their links and are
ordered by role and text; rows with a null conv_id or turn are single messages at position 1; repeated rows stay; other
columns of the input, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_split, materialize

#: A unit that more messages of a conversation say is hot.
RARE = 64
_SIGNS = r"^(?:[ \t]{0,3}>)+[ \t]?"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _SIGNS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, _SIGNS, ""), r"\s+", " ")))


def _runs(parsed: Column) -> Column:
    """Arrays of the neighbouring lines of equal level; a line that holds nothing belongs to none."""
    places = F.sequence(F.lit(0), F.size(parsed) - 1)

    def parts(i: Column, j: Column) -> Column:
        x, y = F.get(parsed, i), F.get(parsed, j)
        return (x["line"] != "") & (F.coalesce(y["line"], F.lit("")) == "") | (x["line"] != "") & (x["level"] != y["level"])

    first, last = F.filter(places, lambda i: parts(i, i - 1)), F.filter(places, lambda i: parts(i, i + 1))
    return F.zip_with(first, last, lambda i, j: F.slice(parsed, i + 1, j - i + 1))


def _said(passage: Column) -> Column:
    return F.array_join(F.transform(passage, lambda y: y["line"]), " ")


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted lines, quoted (level and unit) and own: the distinct units (normalised texts) of a message."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n")
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines.alias("lines"))
    parsed = base.withColumn("parsed", F.transform("lines", lambda x: F.struct(quote_level(x).alias("level"), normalised(x).alias("line"))))
    runs = parsed.withColumn("runs", _runs(F.col("parsed")))
    units = lambda wanted: F.array_distinct(F.concat(F.transform(wanted, _said), F.flatten(F.transform(wanted, lambda r: F.transform(r, lambda y: y["line"])))))
    quoted = F.filter("runs", lambda r: r[0]["level"] > 0)
    at = lambda r, u: F.struct(r[0]["level"].alias("level"), u.alias("unit"))
    each = F.concat(F.transform(quoted, lambda r: at(r, _said(r))), F.flatten(F.transform(quoted, lambda r: F.transform(r, lambda y: at(r, y["line"])))))
    own = F.filter("runs", lambda r: r[0]["level"] == 0)
    whole = F.array_join(F.transform(own, _said), " ")
    return runs.select(
        "conv_id", "turn", "role", F.trim(F.array_join(F.filter("lines", lambda x: quote_level(x) == 0), "\n")).alias("text"),
        F.size(F.filter("parsed", lambda p: (p["level"] > 0) & (p["line"] != ""))).cast("long").alias("n_quoted"),
        F.array_distinct(each).alias("quoted"),
        F.array_distinct(F.concat(units(own), F.when(F.size(own) > 1, F.array(whole)).otherwise(F.array().cast("array<string>")))).alias("own"),
    )


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, parent, matched): of each level at which a message quotes an earlier one, that one's turn and how many of the level's units it says."""
    named, place = parsed.where("conv_id is not null and turn is not null"), ["conv_id", "hash", "unit"]
    hashed = lambda rows: rows.distinct().withColumn("hash", F.xxhash64("unit"))
    quoted = materialize(hashed(named.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.unit")), "quoted-units")
    asked = quoted.groupBy(*place).agg(F.count("*").alias("asked"))
    own = materialize(hashed(named.select("conv_id", "turn", F.explode("own").alias("unit"))).join(asked, place), "own-units")
    total = quoted.count()
    said = own.groupBy(*place, "asked").agg(F.count("*").alias("sayers"))
    hot = materialize(said.where(F.col("sayers") > RARE).withColumn("hid", F.monotonically_increasing_id()), "hot-units")
    rare = own.join(hot.select(*place), place, "left_anti").groupBy(*place, "asked").agg(F.collect_list("turn").alias("turns"))
    ways = join_split(quoted, rare, place, "asked", total).select("conv_id", "turn", "level", F.explode("turns").alias("parent")).where("parent < turn")
    found = ways.groupBy("conv_id", "turn", "level", "parent").agg(F.count("*").alias("n"))
    if not hot.isEmpty():
        found = _with_hot(found, quoted, own, hot, total)
    best = found.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("n", "parent")).alias("best"))
    return best.select("conv_id", "turn", "level", "best.parent", F.col("best.n").alias("matched"))


def _with_hot(found: DataFrame, quoted: DataFrame, own: DataFrame, hot: DataFrame, total: int) -> DataFrame:
    """found (conv_id, turn, level, parent, n) with hot units counted in, and the latest parents of those that share hot units alone."""
    place, sets = ["conv_id", "hash", "unit"], F.array_sort(F.collect_list("hid")).alias("hs")
    asks = materialize(join_split(quoted, hot.select(*place, "asked", "hid"), place, "asked", total).groupBy("conv_id", "turn", "level").agg(sets), "hot-quoted")
    says = materialize(join_split(own.drop("asked"), hot.select(*place, "sayers", "hid"), place, "sayers", own.count()).groupBy("conv_id", "turn").agg(sets), "hot-said")
    both = found.join(asks, ["conv_id", "turn", "level"], "left").join(says.select("conv_id", F.col("turn").alias("parent"), F.col("hs").alias("ps")), ["conv_id", "parent"], "left")
    more = F.coalesce(F.size(F.array_intersect("hs", "ps")), F.lit(0))
    counted = both.select("conv_id", "turn", "level", "parent", (F.col("n") + F.when(F.col("hs").isNull() | F.col("ps").isNull(), 0).otherwise(more)).alias("n"))
    kind = lambda rows, c: rows.select("conv_id", F.col("hs").alias(c)).distinct().select("conv_id", c, F.explode(c).alias("hid"))
    pairs = kind(asks, "qs").join(kind(says, "ps"), ["conv_id", "hid"]).groupBy("conv_id", "qs", "ps").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.withColumn("pair", F.monotonically_increasing_id()), "hot-classes")
    asking = asks.withColumnRenamed("hs", "qs").join(pairs, ["conv_id", "qs"]).select("pair", "conv_id", "turn", "level", "n", F.lit(0).alias("says"), F.lit(None).cast("long").alias("origin"))
    saying = says.withColumnRenamed("hs", "ps").join(pairs, ["conv_id", "ps"]).select("pair", "conv_id", "turn", F.lit(0).alias("level"), "n", F.lit(1).alias("says"), F.col("turn").alias("origin"))
    met = _running(asking.unionByName(saying), ["pair"], ["turn", "says"], "origin", F.max).where("says = 0 and before is not null")
    return counted.unionByName(met.select("conv_id", "turn", "level", F.col("before").alias("parent"), "n"))


def reply_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, matched): of each message that quotes an earlier one, the turn it answers, by the outermost level that is found, and how many of that level's units that one says."""
    outer = quote_links(parsed).groupBy("conv_id", "turn").agg(F.min(F.struct("level", "parent", "matched")).alias("l"))
    return outer.select("conv_id", "turn", "l.parent", "l.matched")


def _doubled(now: DataFrame, value: str, down: bool) -> DataFrame:
    """(conv_id, turn, value) of nodes (conv_id, turn, up, value): value summed over a node's ancestors and itself, or over its subtree (down)."""
    now = materialize(now, "threads")
    while not now.where("up is not null").isEmpty():
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col(value).alias("more"))
        if down:
            below = now.where("up is not null").groupBy("conv_id", "up").agg(F.sum(value).alias("more")).withColumnRenamed("up", "turn")
            total = now.join(below, ["conv_id", "turn"], "left").select("conv_id", "turn", "up", (F.col(value) + F.coalesce("more", F.lit(0))).alias(value))
            grown = total.join(above.drop("more"), ["conv_id", "up"], "left").select("conv_id", "turn", F.col("further").alias("up"), value)
        else:
            joined = now.join(above, ["conv_id", "up"], "left")
            grown = joined.select("conv_id", "turn", F.col("further").alias("up"), (F.col(value) + F.coalesce("more", F.lit(0))).alias(value))
        now = materialize(grown, "threads")
    return now.select("conv_id", "turn", value)


def thread_places(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, top, depth, place) of the nodes of threads: the turn answered, the thread's first turn, the replies above, the rows before in the thread."""
    ends = links.select("conv_id", "turn", "parent").unionByName(links.select("conv_id", F.col("parent").alias("turn"), F.lit(None).cast("long").alias("parent")))
    rows = parsed.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    nodes = materialize(ends.groupBy("conv_id", "turn").agg(F.max("parent").alias("up")).join(rows, ["conv_id", "turn"]), "thread-nodes")
    if nodes.isEmpty():
        return nodes.select("conv_id", "turn", F.col("up").alias("parent"), F.col("turn").alias("top"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("place"))
    size = _doubled(nodes.select("conv_id", "turn", "up", F.col("n").alias("size")), "size", True)
    above = nodes.select("conv_id", F.col("turn").alias("up"), F.col("n").alias("above"))
    replies = _running(nodes.where("up is not null").select("conv_id", "turn", "up").join(size, ["conv_id", "turn"]), ["conv_id", "up"], ["turn"], "size")
    steps = replies.join(above, ["conv_id", "up"]).select("conv_id", "turn", "up", (F.col("before") + F.col("above")).alias("place"))
    place = _doubled(steps.unionByName(nodes.where("up is null").select("conv_id", "turn", "up", F.lit(0).cast("long").alias("place"))), "place", False)
    depth = _doubled(nodes.select("conv_id", "turn", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depth", False)
    top = _doubled(nodes.select("conv_id", "turn", "up", F.when(F.col("up").isNull(), F.col("turn")).otherwise(0).cast("long").alias("top")), "top", False)
    out = nodes.select("conv_id", "turn", F.col("up").alias("parent"))
    for part in (top, depth, place):
        out = out.join(part, ["conv_id", "turn"])
    return out


def _running(rows: DataFrame, key: list[str], order: list[str], value: str, fold: Callable[[str], Column] = F.sum) -> DataFrame:
    """rows with `before`: the sum (or another fold: then null where there is none) of value over the rows of the key that come before. Rows are range-partitioned, so that a key may stretch over many tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *key, *order).withColumn("part", F.spark_partition_id()), "ranged-rows")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*key, "part").agg(fold(value).alias("n")).withColumn("_start", fold("n").over(earlier(Window.partitionBy(*key).orderBy("part"))))
    started = sums.where("_start is not null").select(*key, "part", "_start")
    local = ranged.withColumn("_local", fold(value).over(earlier(Window.partitionBy(*key, "part").orderBy(*order))))
    both = F.coalesce("_local", F.lit(0)) + F.coalesce("_start", F.lit(0)) if fold is F.sum else F.greatest("_local", "_start")
    return local.join(started, [*key, "part"], "left").withColumn("before", both).drop("part", "_local", "_start")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text without quotes, n_quoted lines, parent_turn, depth and position in reply order."""
    parsed = materialize(parse(messages), "parsed-messages")
    places = materialize(thread_places(parsed, materialize(reply_links(parsed), "reply-links")), "thread-places")
    known = parsed.join(places, ["conv_id", "turn"], "left").withColumns({"top": F.coalesce("top", "turn"), "place": F.coalesce("place", F.lit(0)), "depth": F.coalesce("depth", F.lit(0))})
    order = ["top", "place", "turn", "role", "text"]
    ordered = _running(known.select("conv_id", *order, "n_quoted", F.col("parent").alias("parent_turn"), "depth", F.col("turn").isNotNull().cast("int").alias("one")), ["conv_id"], order, "one")
    single = F.col("conv_id").isNull() | F.col("turn").isNull()
    return ordered.select("conv_id", "turn", "role", "text", "n_quoted", "parent_turn", "depth", F.when(single, F.lit(1)).otherwise(F.col("before") + 1).cast("long").alias("position"))


def conversations(ordered: DataFrame) -> DataFrame:
    """conv_id and messages, an array of (role, content) in reply order, of reply_ordered()'s rows."""
    grouped = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", F.col("text").alias("content")))).alias("m"))
    return grouped.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
