"""Derived memories: consolidation, clusters, reconstruction, cases and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, words

from .components import connected_components
from .nearest import linked
from .stored import stored


def consolidate(hits: DataFrame, support: DataFrame, fallback: int = 3) -> DataFrame:
    """(q, nodes, n_support, confidence, id): what a query's hits leave as a long-term memory: its supported hits, or else the first few."""
    marked = hits.join(support.select("q", "node").withColumn("ok", F.lit(True)), ["q", "node"], "left")
    held = marked.groupBy("q").agg(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("node")))).alias("good"), F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("all"))
    first = F.array_sort(F.transform(F.slice("all", 1, fallback), lambda x: x["node"]))
    nodes = F.when(F.size("good") > 0, F.col("good")).otherwise(first)
    confidence = F.when(F.size("good") > 0, F.least(F.lit(0.96), 0.70 + 0.06 * F.size("good"))).otherwise(0.62)
    out = held.select("q", nodes.alias("nodes"), F.size("good").cast("long").alias("n_support"), confidence.alias("confidence"))
    return out.withColumn("id", text.stable_id("con", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string")))))


def meaningful(kw: Column) -> Column:
    return F.filter(kw, lambda k: (F.trim(k) != "") & ~F.lower(F.trim(k)).isin(words.INSIGHT_STOP_KEYWORDS))


def content(kw: Column, limit: int) -> Column:
    return F.slice(F.array_distinct(F.filter(kw, lambda k: (F.trim(k) != "") & ~F.lower(F.trim(k)).isin(words.RECONSTRUCTION_STOP_KEYWORDS))), 1, limit)


def insight_clusters(memories: DataFrame, key: str, keywords: str, least: int = 2) -> DataFrame:
    """(key, cluster): each memory's first keyword that `least` memories have, or else its first keyword; clusters of fewer members drop out. If none is left and there are enough memories, all are one general cluster."""
    each = memories.select(key, F.posexplode(meaningful(F.col(keywords))).alias("pos", "kw"))
    counts = each.groupBy("kw").agg(F.count("*").alias("n"))
    choice = each.join(counts, "kw").groupBy(key).agg(F.min(F.struct((F.col("n") < least).alias("rare"), "pos", "kw")).alias("c")).select(key, F.col("c.kw").alias("cluster"))
    named = memories.select(key).join(choice, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit("general")))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size"))
    kept = named.join(sizes, "cluster").where(F.col("size") >= least).where("cluster <> 'general'").select(key, "cluster", "size")
    total = memories.agg(F.count("*").alias("size")).where(F.col("size") >= least)
    none = kept.limit(1).select(F.lit(1).alias("some"))
    general = memories.select(key).join(total).join(none, F.lit(True), "left").where("some is null").select(key, F.lit("general").alias("cluster"), "size")
    return kept.unionByName(general)


def most_shared(cases: DataFrame, key: str, keywords: str, score: Column, k: int) -> DataFrame:
    """(a, b, shared, s, rank): each case's best k others by score, then by smaller key, of those that share keywords. keywords: an array of few distinct words (2^n subsets are looked at).

    score is of shared, n_a and n_b (the sides' numbers of keywords) and does not fall as shared rises. A case meets another
    at every set of words that both have. Of the cases that have all of a set, only the first k + 1 of each number of
    keywords are met: any later one has k others before it that are as large, share as much and have a smaller key, or
    that is the case itself. Rows grow with the cases, however many share a word.
    """
    sets = F.aggregate(F.array_sort(keywords), F.array(F.lit("")), lambda got, w: F.concat(got, F.transform(got, lambda g: F.concat(g, F.lit("\x01"), w))))
    each = cases.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.size(keywords).alias("n"), F.explode(F.slice(sets, 2, 1 << 30)).alias("words"))
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy("words", "n").orderBy("id"))).where(F.col("_r") <= k + 1)
    # 2^n rows a case of which Spark's estimate tells one: never to be broadcast
    met = each.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "words").join(first.select(F.col("id").alias("b"), F.col("n").alias("n_b"), "words").hint("merge"), "words").where("a <> b")
    size = F.length("words") - F.length(F.replace("words", F.lit("\x01"), F.lit("")))
    pairs = met.groupBy("a", "b").agg(F.max(size).cast("long").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return ranked(pairs.withColumn("s", score), ["a"], [F.desc("s"), "b"], k)


def hybrid_score(cos: Column, kw_a: Column, kw_b: Column, ev_a: Column, ev_b: Column, answer_a: Column, answer_b: Column) -> Column:
    """kw_a and kw_b: the sides' content() keywords."""
    same = F.when((answer_a != "") & (answer_a == answer_b), 1.0).otherwise(0.0)
    return 0.35 * F.greatest(F.lit(0.0), cos) + 0.35 * text.jaccard(kw_a, kw_b) + 0.20 * text.jaccard(ev_a, ev_b) + 0.10 * F.coalesce(same, F.lit(0.0))


def greedy_clusters(memories: DataFrame, group: str, key: str, vector: str, threshold: float = 0.82) -> DataFrame:
    """(group, key, cluster): each memory of a group, in the order of keys, joins the nearest cluster's centroid from the threshold on, or begins a cluster, which has its key.

    The order matters, but not for memories far from each other: a centroid is a sum s of members, each of which was within
    the threshold t of the sum before it, so |s| >= t * (the sum of their lengths), and a memory's cosine with s is at most
    1/t times its largest with a member. A memory that joins a cluster therefore has a cosine of t*t or more with one of its
    members, and components of such links (found without all pairs) never touch each other. Memories without a link are
    clusters; each component is walked in order, a row at a time, holding its centroids alone. The result is the sequential
    one. Null keys, groups and vectors take no part; keys are distinct long integers.
    """
    import numpy as np
    import pyarrow as pa

    given = memories.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vector).isNotNull())
    held = stored(given.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    parts = connected_components(stored(linked(held, threshold * threshold - 1e-9)))
    placed = held.join(parts, "id", "left")
    kind = dict(held.dtypes)["grp"]

    def walk(batches):
        now, sums = None, np.zeros((0, 0))
        for b in batches:
            grp, label, ids, vectors = (b.column(c).to_pylist() for c in ("grp", "label", "id", "v"))
            out = []
            for g, part, i, v in zip(grp, label, ids, vectors, strict=True):
                x = np.asarray(v, float)
                if (g, part) != now:
                    now, sums, first = (g, part), np.zeros((0, len(x))), []
                length = np.linalg.norm(sums, axis=1)
                scores = (sums / np.where(length > 0, length, 1.0)[:, None]) @ (x / (np.linalg.norm(x) or 1.0))
                best = int(np.argmax(scores)) if len(scores) else -1
                if best >= 0 and scores[best] >= threshold:
                    sums[best] += x
                else:
                    best, sums = len(first), np.vstack([sums, x])
                    first.append(i)
                out.append(first[best])
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("id"), pa.array(out, pa.int64())], ["grp", "id", "cluster"])

    ordered = placed.where("label is not null").repartition("grp", "label").sortWithinPartitions("grp", "label", "id")
    walked = ordered.select("grp", "label", "id", "v").mapInArrow(walk, f"grp {kind}, id long, cluster long")
    alone = placed.where("label is null").select("grp", "id", F.col("id").alias("cluster"))
    return walked.unionByName(alone).select(F.col("grp").alias(group), F.col("id").alias(key), "cluster")


def reconstruction_metrics(memories: DataFrame, groups: DataFrame, strategies: list[str]) -> DataFrame:
    """What each strategy's groups make of the memories, a row a strategy, also where it has no groups.

    memories: (id, ev, answer); groups: (strategy, g, id). Support is evidence of two memories or more; a memory is traced in
    full if all support among its evidence is in groups; a group's answers agree by the share of the most common one.
    """
    named = [F.lit(s).alias("strategy") for s in strategies]
    total = memories.agg(F.count("*").alias("n")).withColumn("strategy", F.explode(F.array(*named)))
    each = stored(memories.select("id", F.explode(F.array_distinct("ev")).alias("e")))
    known = stored(each.groupBy("e").agg(F.count("*").alias("held")).select("e", (F.col("held") > 1).alias("support")))
    whole = known.agg(F.count("*").alias("evidence"), F.count_if("support").alias("wanted"))
    in_group = stored(groups.join(each, "id").groupBy("strategy", "g", "e").agg(F.count("*").alias("_")).join(known, "e"))
    traced = in_group.groupBy("strategy").agg(F.count("*").alias("trace_edges"))
    unique = in_group.groupBy("strategy", "e").agg(F.max("support").alias("support"))
    kinds = unique.groupBy("strategy").agg(F.count("*").alias("unique"), F.count_if("support").alias("traced"))
    asked = each.join(known.where("support").select("e"), "e").withColumn("strategy", F.explode(F.array(*named)))
    full = asked.join(unique.select("strategy", "e", F.lit(1).alias("in")), ["strategy", "e"], "left").groupBy("strategy", "id").agg((F.count("in") == F.count("*")).cast("int").alias("full")).groupBy("strategy").agg(F.avg("full").alias("full_trace"))
    answers = groups.join(memories.select("id", "answer"), "id").where("answer is not null and answer <> ''").groupBy("strategy", "g", "answer").agg(F.count("*").alias("n"))
    agreed = answers.groupBy("strategy", "g").agg((F.max("n") / F.sum("n")).alias("agree"))
    sizes = groups.groupBy("strategy", "g").agg(F.count("*").alias("size")).join(agreed, ["strategy", "g"], "left")
    shape = sizes.groupBy("strategy").agg(F.count("*").alias("groups"), F.avg("size").alias("average_group_size"), F.avg(F.coalesce("agree", F.lit(0.0))).alias("answer_consistency"))
    reached = groups.select("strategy", "id").distinct().groupBy("strategy").agg(F.count("*").alias("ids"))
    rows = total.crossJoin(whole)  # one row of whole
    for part in (traced, kinds, full, shape, reached):
        rows = rows.join(part, "strategy", "left")
    rows = rows.fillna(0)
    share = lambda a, b: text.safe_divide(F.col(a).cast("double"), F.col(b))
    units = F.when(F.col("groups") == 0, F.col("n")).otherwise(F.col("groups"))
    rows = rows.withColumns({"units": units, "compression_ratio": text.safe_divide(F.col("n").cast("double"), units)}).withColumns(
        {
            "covered": share("ids", "n"), "redundancy": text.safe_divide((F.col("trace_edges") - F.col("unique")).cast("double"), F.col("trace_edges")), "evidence_coverage": share("unique", "evidence"), "support_trace": share("traced", "wanted"),
            "trace_noise": text.safe_divide((F.col("unique") - F.col("traced")).cast("double"), F.col("unique")),
        }
    )
    quality = 0.34 * F.col("support_trace") + 0.24 * F.col("full_trace") + 0.18 * F.col("answer_consistency") + 0.14 * F.col("evidence_coverage") + 0.10 * F.least(F.lit(1.0), F.log2(1.0 + F.col("compression_ratio")) / 3.0)
    return rows.select("strategy", "units", "compression_ratio", "covered", "trace_edges", "redundancy", "evidence_coverage", "support_trace", "full_trace", "trace_noise", "answer_consistency", "average_group_size", F.round(quality, 6).alias("quality"))


def entity_bridges(units: DataFrame, least_shared: int = 1) -> DataFrame:
    """(a_object, a_unit, b_object, b_unit, entity): units of different objects that share an entity, both ways. units: (object, unit, entity)."""
    u = units.distinct()
    a, b = (u.select("entity", F.col("object").alias(f"{p}_object"), F.col("unit").alias(f"{p}_unit")) for p in "ab")
    return a.join(b, "entity").where("a_object <> b_object")


def delta(existing: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and change: added, updated or same, of the incoming rows."""
    old = existing.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there"))
    state = F.when(F.col("_there").isNull(), "added").when(~F.col(value).eqNullSafe(F.col("_old")), "updated").otherwise("same")
    return incoming.join(old, keys, "left").select(*keys, state.alias("change"))


def ranked(rows: DataFrame, part: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)
