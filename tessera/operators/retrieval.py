"""Associative retrieval of all queries at once: activation, a walk whose edges are made on the way, and scores under different settings.

A query's candidates are the nodes of its context. Which walk a setting takes depends on few of its switches, so settings
share their walks, and only the scores are of each one. Edges that rest on rules are made around the nodes that a walk goes
on from, when it gets there, once for all queries and walks: Edges keeps the table, which grows from hop to hop, and the
pairs that were scored for it. A walk that comes to every node of a context makes the square of its edges; contexts are what
bounds it, as in any search of simple paths.

Ties go by the candidates' `ord`. A round reads one version of usage and activations; finalise() folds a round into the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors

from . import graph, state
from .evaluation import analogy_signal
from .stored import stored


@dataclass(frozen=True)
class Setting:
    """Switches of a retrieval."""

    use_graph: bool = True
    on_demand: bool = True
    multipath: bool = True
    memory_state: bool = True
    update_state: bool = True
    summaries: bool = False
    vector_keep: int = 1
    adaptive: bool = False
    analogy: bool = False
    lexical: bool = False
    feedback: bool = True


#: The settings that are compared, what an adaptive anchor keeps below which mean path support, and the cases that lend to a query.
SETTINGS = {
    "full": Setting(),
    "no_multipath": Setting(multipath=False),
    "no_memory_state": Setting(memory_state=False),
    "no_graph": Setting(use_graph=False, on_demand=False),
    "static_graph": Setting(on_demand=False, update_state=False, feedback=False),
    "no_summary": Setting(summaries=False),
    "with_summary": Setting(summaries=True),
    "no_feedback": Setting(feedback=False),
    "vector_anchor": Setting(vector_keep=2),
    "adaptive_anchor": Setting(adaptive=True),
    "with_analogy": Setting(analogy=True),
    "no_lexical_activation": Setting(lexical=False),
    "with_lexical_activation": Setting(lexical=True),
}
ADAPTIVE_KEEP, ADAPTIVE_THRESHOLD, CASES = 2, 0.75, 2
CONTEXT_WEIGHT, SUMMARY_WEIGHT, LEXICAL_WEIGHT = 0.08, 0.32, 0.24
#: Columns of nodes: id, ctx (its context), ord, summary (whether it stands for the whole context), kw, ents, v, usage, conf.
NODE = ["id", "ctx", "ord", "summary", "kw", "ents", "v", "usage", "conf"]


def candidates(queries: DataFrame, nodes: DataFrame, lexical: Callable[[], Column]) -> DataFrame:
    """(q, node, ord, summary, cos, lexical, usage, conf) of each query (q, ctx, v, ..) and each other node of its context."""
    asked = queries.select("q", "ctx", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("q", "ctx")])
    both = asked.join(nodes, "ctx").where("id <> q")
    cos = F.round(F.coalesce(vectors.dot(F.col("q_v"), F.col("v")), F.lit(0.0)), 9)
    return both.select("q", F.col("id").alias("node"), "ord", "summary", cos.alias("cos"), F.when(F.col("summary"), 0.0).otherwise(lexical()).alias("lexical"), "usage", "conf")


def hits(cand: DataFrame, lexical: bool, k: int) -> DataFrame:
    """(q, node, rank): each query's k most active nodes, but summaries."""
    extra = LEXICAL_WEIGHT * F.col("lexical") if lexical else F.lit(0.0)
    score = F.round(graph.activation_score(F.col("cos"), F.col("usage"), F.col("conf")) + extra, 9)
    order = Window.partitionBy("q").orderBy(F.desc("s"), "ord")
    return cand.where("not summary").withColumn("s", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "node", "rank")


class Edges:
    """Rule edges (ctx, src, dst, weight, relation) that grow with the nodes that walks go on from."""

    def __init__(self, nodes: DataFrame, rule: Callable[[DataFrame], DataFrame] = state.edge_rule):
        self.nodes, self.rule = nodes, rule
        self.made: DataFrame | None = None
        self.around: DataFrame | None = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """The edges around the wanted nodes (id), of which those that nobody wanted before are made now."""
        new = wanted.select("id").distinct()
        new = stored(new if self.around is None else new.join(self.around, "id", "left_anti"))
        self.around = new if self.around is None else self.around.unionByName(new)
        side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("id", "kw", "ents", "v")]
        pairs = self.nodes.join(new, "id", "left_semi").select("ctx", *side("a")).join(self.nodes.select("ctx", *side("b")), "ctx").where("a_id <> b_id")
        scored = self.rule(pairs.withColumn("cos", F.round(F.coalesce(vectors.dot(F.col("a_v"), F.col("b_v")), F.lit(0.0)), 9))).where("relation_type is not null")
        fresh = stored(scored.select("ctx", F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "weight", F.col("relation_type").alias("relation")))
        self.made = fresh if self.made is None else self.made.unionByName(fresh)
        return self.made

    def cost(self) -> DataFrame:
        """One row: pairs_scored so far, and edges_built from them, both ways counted."""
        sizes = self.nodes.groupBy("ctx").agg((F.count("*") - 1).alias("n"))
        scored = self.nodes.join(self.around, "id", "left_semi").join(sizes, "ctx").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_scored"))
        both = self.made.select("src", "dst", "relation").unionByName(self.made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")).distinct()
        return scored.crossJoin(both.agg(F.count("*").alias("edges_built")))  # one row each


def _around(edges: DataFrame) -> DataFrame:
    """Edges made from src, as steps from it: an edge and its reverse are two ways to the neighbour."""
    ahead = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "src", "dst", "weight", "relation")
    return ahead.unionByName(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "relation"))


def context_steps(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps from ends (id) to the other nodes of their context, both ways."""
    plain = nodes.where("not summary").select("id", "ctx")
    met = plain.join(ends, "id", "left_semi").select(F.col("id").alias("src"), "ctx").join(plain.select(F.col("id").alias("dst"), "ctx"), "ctx").where("src <> dst")
    return _around(met.select("src", "dst", F.lit(CONTEXT_WEIGHT).alias("weight"), F.lit("context_cooccurrence").alias("relation")))


def summary_steps(nodes: DataFrame) -> DataFrame:
    """Steps between the summary of a context and its nodes, from either end, along both edges there are."""
    top, low = nodes.where("summary").select("ctx", F.col("id").alias("s")), nodes.where("not summary").select("ctx", F.col("id").alias("c"))
    held = top.join(low, "ctx").select("s", "c", F.explode(F.array(F.lit("summary_parent"), F.lit("summary_child"))).alias("relation"))
    way = lambda a, b: held.select(F.col(a).alias("node"), F.col(b).alias("next"), F.when(F.col("relation") == "summary_parent", F.col("s")).otherwise(F.col("c")).alias("src"), F.when(F.col("relation") == "summary_parent", F.col("c")).otherwise(F.col("s")).alias("dst"), F.lit(SUMMARY_WEIGHT).alias("weight"), "relation")
    return way("s", "c").unionByName(way("c", "s"))


def walk(start: DataFrame, hops: int, nodes: DataFrame, edges: Edges | None, summaries: bool) -> tuple[DataFrame, DataFrame]:
    """(signals, best) of a breadth-first walk from the first hits.

    start: (q, node, rank, seed), a query's hits; its seeds are where it begins. Without `edges` only the context's own
    edges are there. Context edges are taken from the seeds alone. signals: each step taken; best: (q, node, path, g), the
    first of the best paths. An arrival goes on if it beats all before it, in the order of the queue. Graph scores have nine
    digits, so that paths of equal weights tie whatever the order of addition.
    """
    frontier = start.where("seed").select("q", "node", F.array("node").alias("path"), F.lit(0.0).alias("g"), F.col("rank").cast("long").alias("ord"))
    reached = start.select("q", "node", F.array("node").alias("path"), F.lit(0.0).alias("g"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"))
    hidden = nodes.where("summary").select(F.col("id").alias("next"))
    signals: DataFrame | None = None
    for depth in range(hops):
        frontier = stored(frontier)
        ends = frontier.select(F.col("node").alias("id")).distinct()
        ways = [_around(edges.of(ends).join(ends.withColumnRenamed("id", "src"), "src", "left_semi"))] if edges else []
        if depth == 0:
            ways.append(context_steps(ends, nodes))
        if summaries:
            ways.append(summary_steps(nodes))
        if not ways:
            break
        steps = ways[0]
        for w in ways[1:]:
            steps = steps.unionByName(w)
        if not summaries:
            steps = steps.join(hidden, "next", "left_anti")
        best = reached.groupBy("q", "node").agg(F.max("g").alias("so_far"))
        took = frontier.join(steps, "node").where((F.col("next") != F.col("q")) & ~F.array_contains("path", F.col("next"))).select(
            "q", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), F.round(F.col("g") + F.col("weight") / (depth + 1), 9).alias("g"), "relation", F.col("ord").alias("from_ord"), "src", "dst", F.lit(depth + 1).alias("depth")
        )
        queue = ["from_ord", "src", "dst", "relation"]
        arrival = Window.partitionBy("q", "node").orderBy(*queue).rowsBetween(Window.unboundedPreceding, -1)
        step = stored(took.withColumn("before", F.max("g").over(arrival)).withColumn("ord", F.row_number().over(Window.partitionBy("q").orderBy(*queue)).cast("long")))
        signals = step if signals is None else signals.unionByName(step)
        none = F.lit(float("-inf"))
        better = step.join(best, ["q", "node"], "left").where((F.col("g") > F.coalesce("before", none)) & (F.col("g") > F.coalesce("so_far", none)))
        frontier = better.select("q", "node", "path", "g", "ord")
        reached = reached.unionByName(better.select("q", "node", "path", "g", "depth", "ord"))
    first = Window.partitionBy("q", "node").orderBy(F.desc("g"), "depth", "ord")
    best = reached.withColumn("r", F.row_number().over(first)).where("r = 1").select("q", "node", "path", "g")
    if signals is None:
        signals = start.limit(0).select("q", "node", F.array("node").alias("path"), F.lit(0.0).alias("g"), F.lit("").alias("relation"), F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0).alias("depth"))
    return signals.select("q", "node", "path", "g", "relation", "src", "dst", "depth"), best


def lend(signals: DataFrame, best: DataFrame, loans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The walk with what similar cases lend. loans: (q, node, case, match, conf), a row for each support node of a query's cases, of which the best case's counts."""
    order = Window.partitionBy("q", "node").orderBy(F.desc("match"), "case")
    score, boost = analogy_signal(F.col("match"), F.col("conf"))
    lent = loans.withColumn("r", F.row_number().over(order)).where("r = 1").select("q", "node", F.array("case", "node").alias("path"), F.round(score, 9).alias("g"), boost.alias("boost"))
    more = lent.select("q", "node", "path", "g", F.lit("analogy_case_reuse").alias("relation"), F.col("path")[0].alias("src"), F.col("node").alias("dst"), F.lit(1).alias("depth"))
    old = best.select("q", "node", F.col("path").alias("p"), F.col("g").alias("b"))
    both = old.join(lent, ["q", "node"], "full")
    take = F.col("b").isNull() | (F.col("g") > F.col("b"))
    merged = both.select("q", "node", F.when(take, F.col("path")).otherwise(F.col("p")).alias("path"), F.when(take, F.col("g")).otherwise(F.col("b")).alias("g"), "boost")
    return signals.unionByName(more), merged


def scored(best: DataFrame, signals: DataFrame, cand: DataFrame, activations: DataFrame | None, setting: Setting, profile: str) -> DataFrame:
    """(q, node, ord, summary, path, g, n_paths, path_support, edge_memory, score) of the nodes that a walk reached. activations: (src, dst, relation, n) of edges, if any were active."""
    lent = F.when(F.col("relation") == "analogy_case_reuse", 1).otherwise(0)
    of = signals.withColumn("activations", lent) if activations is None else signals.join(activations, ["src", "dst", "relation"], "left").withColumn("activations", F.coalesce("n", lent)).drop("n")
    rows = best.join(cand, ["q", "node"]).join(graph.path_features(of), ["q", "node"], "left")
    zero = lambda c: F.lit(0.0).alias(c)
    kept = lambda c, on: F.coalesce(F.col(c), F.lit(0.0)).alias(c) if on else zero(c)
    multi, held = setting.multipath, setting.memory_state
    rows = rows.select(
        "q", "node", "ord", "summary", "path", "g", "cos", "conf", *(["boost"] if "boost" in best.columns else []), (F.coalesce("n_paths", F.lit(0)) if multi else F.lit(1)).cast("long").alias("n_paths"),
        kept("path_support", multi), kept("noise", multi), kept("weak", multi), kept("edge_memory", multi and held), (F.col("usage") if held else F.lit(0)).alias("usage"),
    )
    total = graph.rerank(rows, profile) + (F.coalesce("boost", F.lit(0.0)) if "boost" in rows.columns else 0.0)
    return rows.select("q", "node", "ord", "summary", "path", "g", "n_paths", "path_support", "edge_memory", F.round(total, 9).alias("score"))


def final(rows: DataFrame, vector: DataFrame, setting: Setting, k: int, seeds: int) -> DataFrame:
    """(q, node, rank, ..): the first k of scored(): the anchors in the order of the vector hits (q, node, rank), then the best scores; summaries only fill up."""
    keep = F.lit(min(k, max(seeds, setting.vector_keep)))
    if setting.adaptive:
        whole = Window.partitionBy("q")
        weak = F.coalesce(F.avg(F.when(F.size("path") > 1, F.col("path_support"))).over(whole), F.lit(0.0)) < ADAPTIVE_THRESHOLD
        rows = rows.withColumn("_keep", F.when(weak, F.greatest(keep, F.lit(min(k, ADAPTIVE_KEEP)))).otherwise(keep))
        keep = F.col("_keep")
    marked = rows.join(vector.select("q", "node", F.col("rank").alias("_v")), ["q", "node"], "left").withColumn("anchor", F.coalesce(F.col("_v") <= keep, F.lit(False)))
    order = Window.partitionBy("q").orderBy("summary", F.desc("anchor"), F.when(F.col("anchor"), F.col("_v")), F.desc("score"), "ord")
    return marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_v", "_keep")


def finalise(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with usage, activations (src, dst, relation, n)) after a round: each hit is one access, each step on a hit's path activates the strongest edge there is from its one end to the other.

    edges: (src, dst, weight, relation). Steps that stand on no edge (a case that lent a node) activate none.
    """
    used = found.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("_n"))
    after = nodes.join(used, "id", "left").withColumn("usage", F.col("usage") + F.coalesce("_n", F.lit(0))).drop("_n")
    steps = state.path_edges(found, ["q"]).distinct()
    strongest = Window.partitionBy("src", "dst").orderBy(F.desc("weight"), "relation")
    best = edges.join(steps.select("src", "dst").distinct(), ["src", "dst"], "left_semi").withColumn("_r", F.row_number().over(strongest)).where("_r = 1")
    return after, steps.join(best, ["src", "dst"]).groupBy("src", "dst", "relation").agg(F.count("*").alias("n"))
