"""Graph operators on edge lists: transitions, normalisation, propagation, distances, ripples."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import vocabulary as V
from .checkpoint import cut


def weight_of(column: Column, weights: dict[str, float], other: float) -> Column:
    """The weight of a name, by a literal map, so that no join is needed."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, column), F.lit(other))


def relation_weight(relation: Column) -> Column:
    return weight_of(relation, V.RELATION_WEIGHTS, V.OTHER_RELATION_WEIGHT)


def resource_node(relation: Column, target: Column) -> Column:
    return F.concat(F.lit("@resource:"), C.resource_family(relation, "edge-function"), F.lit(":"), F.lower(target))


def ripple_scores(facts: DataFrame, source: str, target: str, relation: str, changed: DataFrame, changed_col: str) -> DataFrame:
    """path and score: the weights of the facts that end there, a loop counting twice, without changed paths."""
    ends = facts.select(F.explode(F.array(source, target)).alias("path"), relation_weight(F.col(relation)).alias("_w")).where("path IS NOT NULL AND path <> ''")
    return ends.join(changed.select(F.col(changed_col).alias("path")), "path", "left_anti").groupBy("path").agg(F.sum("_w").alias("score"))


def temporal_activity(symbols: DataFrame, authority: DataFrame) -> DataFrame:
    """path and activity: how much of a migration's definitions are still in force; 1 for other files."""
    versioned = F.col("kind").isin(V.VERSIONED_KINDS)
    own = symbols.groupBy("path").agg(F.count_if(versioned).alias("_all"), F.sum(F.when(versioned, F.col("active")).otherwise(0)).alias("_on"), F.max((F.col("kind") == "table").cast("int")).alias("_table"))
    rows = authority.join(own, "path", "left")
    part = F.when(F.coalesce("_all", F.lit(0)) == 0, 0.8).otherwise(F.greatest(F.when(F.col("_table") == 1, 0.8).otherwise(0.12), F.col("_on") / F.col("_all")))
    return rows.select("path", F.when(F.col("authority") != "schema_history", 1.0).otherwise(part).alias("activity"))


def node_factors(symbols: DataFrame, authority: DataFrame) -> DataFrame:
    """path and factor: its class's propagation weight times its activity."""
    by_class = weight_of(F.col("authority"), V.PROPAGATION_WEIGHTS, V.PROPAGATION_WEIGHTS["unknown"])
    return authority.join(temporal_activity(symbols, authority), "path").select("path", (by_class * F.col("activity")).alias("factor"))


def transitions(edges: DataFrame, variant: str = "temporal", factors: DataFrame | None = None) -> DataFrame:
    """The weighted steps that an edit may take: source, target, relation, direction, evidence_target, evidence_path, weight, lines.

    edges: source_path, relation, target_name, target_path, line, resolution_confidence. topology counts every relation
    alike; typed weighs relations and confidences; resources adds a node for each resource that files share; temporal
    also scales a step by the ``factors`` (path, factor) of the file that it enters. Repeated evidence adds by its logarithm.
    """
    if variant not in ("topology", "typed", "resources", "temporal"):
        raise ValueError("variant must be topology, typed, resources or temporal")
    typed = variant != "topology"
    own = edges.where(F.col("relation").isin(list(V.RELATION_WEIGHTS)))
    confidence = weight_of(F.col("resolution_confidence"), V.CONFIDENCE_WEIGHTS, V.CONFIDENCE_WEIGHTS["unresolved"])
    base = relation_weight(F.col("relation")) / max(V.RELATION_WEIGHTS.values()) * confidence if typed else F.lit(1.0)
    source, target, relation = F.col("source_path"), F.coalesce("target_path", F.lit("")), F.col("relation")
    name = F.coalesce("target_name", F.lit(""))
    into_source = into_target = F.lit(1.0)
    if variant == "temporal":
        if factors is None:
            raise ValueError("the temporal variant needs factors")
        unknown = F.lit(V.PROPAGATION_WEIGHTS["unknown"])
        one, two = (factors.select(F.col("path").alias(p), F.col("factor").alias(f)) for p, f in (("source_path", "_into_source"), ("target_path", "_into_target")))
        own = own.join(one, "source_path", "left").join(two, "target_path", "left")
        into_source, into_target = F.coalesce("_into_source", unknown), F.coalesce("_into_target", unknown)
    down = F.lit(V.DIRECTION_WEIGHTS["toward_dependency"] if typed else 1.0)

    def step(a: Column, b: Column, direction: str, weight: Column, holds: Column) -> Column:
        return F.when(holds & (a != "") & (b != "") & (a != b), F.struct(a.alias("source"), b.alias("target"), F.lit(direction).alias("direction"), weight.alias("_w")))

    linked = target != ""
    steps = [step(source, target, "toward_dependency", base * down * into_target, linked), step(target, source, "toward_dependent", base * into_source, linked)]
    if variant in ("resources", "temporal"):
        node = resource_node(relation, name)
        public = relation.isin(V.RESOURCE_RELATIONS) & C.shareable(relation, name)
        steps += [step(source, node, "toward_resource", base * V.DIRECTION_WEIGHTS["toward_resource"], public), step(node, source, "toward_consumer", base * into_source, public)]
    rows = own.select("relation", name.alias("evidence_target"), source.alias("evidence_path"), F.coalesce("line", F.lit(1)).alias("line"), F.explode(F.filter(F.array(*steps), lambda x: x.isNotNull())).alias("_s"))
    keys = ["source", "target", "relation", "direction", "evidence_target", "evidence_path"]
    rows = rows.select("_s.*", "relation", "evidence_target", "evidence_path", "line")
    grouped = rows.groupBy(*keys).agg(F.max("_w").alias("_w"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("line")).alias("lines"))
    return grouped.select(*keys, (F.col("_w") * (1.0 + 0.08 * F.log1p(F.col("_n") - 1))).alias("weight"), "lines")


def normalised(steps: DataFrame, seeds: DataFrame | None = None, ranges: DataFrame | None = None, focus: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``steps`` with probability: the weight's share of all steps from the same source.

    At a seed (column path) with changed ``ranges`` (path, range_start, range_end) steps to dependencies and resources
    count 2.5 times if a line of theirs is in a range, else 0.2 times (not at all if ``strict``). ``focus`` words in what a seed's
    step names raise its weight. Sources whose weights add up to nothing drop out.
    """
    from ..functions.text import lexical_tokens

    out, weight = steps, F.col("weight")
    if seeds is not None:
        out = out.join(seeds.select(F.col("path").alias("source"), F.lit(True).alias("_seed")).distinct(), "source", "left")
        seed = F.coalesce("_seed", F.lit(False))
        if ranges is not None:
            by_path = ranges.groupBy(F.col("path").alias("source")).agg(F.collect_list(F.struct("range_start", "range_end")).alias("_ranges"))
            out = out.join(by_path, "source", "left")
            touches = F.exists("lines", lambda n: F.exists("_ranges", lambda r: n.between(r["range_start"], r["range_end"])))
            gated = seed & F.col("_ranges").isNotNull() & F.col("direction").isin("toward_dependency", "toward_resource")
            weight = F.when(gated & touches, weight * 2.5).when(gated, weight * (0.0 if strict else 0.2)).otherwise(weight)
        if focus:
            words = lexical_tokens(F.concat_ws(" ", "evidence_target", "target"))
            shared = F.size(F.array_intersect(words, F.array(*map(F.lit, focus))))
            weight = F.when(seed & (shared > 0), weight * (1.0 + F.least(F.lit(2.5), 0.75 * shared))).otherwise(weight)
    out = out.withColumn("_weight", weight)
    total = out.groupBy("source").agg(F.sum("_weight").alias("_total")).where("_total > 0")
    return out.join(total, "source").select(*steps.columns, (F.col("_weight") / F.col("_total")).alias("probability"))


#: Where the walk stands before it goes on from one of its seeds; no path and no resource is called so.
_AT_SEEDS = "@seeds"


def page_rank(probabilities: DataFrame, seeds: DataFrame, restart: float = V.RESTART, rounds: int = V.MOST_ROUNDS, tolerance: float = V.TOLERANCE, every: int = 1, fixed: bool = False) -> DataFrame:
    """node, mass, rounds and residual of personalised PageRank: a surfer restarts at the seeds (column path) and from nodes without a way out.

    probabilities: source, target, probability. The mass stays 1. All that restarts waits at one node, whose steps are
    those of the seeds by their shares, so that nodes without a way out need one row each, whatever the number of seeds.
    Every round is a join and an aggregate that combines before the shuffle; after ``every`` rounds the state is cut by a
    checkpoint and the last round's change measured, which ends the walk once it is within the tolerance. With ``fixed`` all rounds run as
    one plan over the steps, and no residual is known.
    """
    start = cut(seeds.select(F.col("path").alias("node")).distinct())
    start = cut(start.withColumn("_share", F.lit(1.0 / max(1, start.count()))))
    steps = probabilities.groupBy("source", "target").agg(F.sum("probability").alias("probability"))
    at_seeds, named = F.lit(_AT_SEEDS), start.select(F.col("node").alias("source"), "_share")
    out = steps.select("source").distinct()
    ends = steps.select(F.col("target").alias("source")).distinct().join(out, "source", "left_anti").select("source", at_seeds.alias("target"), F.lit(1.0).alias("probability"))
    first = steps.join(named, "source").select("target", (F.col("_share") * F.col("probability")).alias("probability"))
    first = first.unionByName(named.join(out, "source", "left_anti").select(at_seeds.alias("target"), F.col("_share").alias("probability")))
    first = first.groupBy("target").agg(F.sum("probability").alias("probability")).select(at_seeds.alias("source"), "target", "probability")
    steps = cut(steps.unionByName(ends).unionByName(first))  # every round reads them
    again = start.select(at_seeds.alias("node"), F.lit(restart).alias("mass")).distinct()

    def spread(state: DataFrame) -> DataFrame:
        """What waits at the seeds' node, at the seeds."""
        waiting = state.where(F.col("node") == at_seeds).agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("_waits"))  # one row
        own = start.crossJoin(waiting).select("node", (F.col("_share") * F.col("_waits")).alias("mass"))
        return state.where(F.col("node") != at_seeds).unionByName(own).groupBy("node").agg(F.sum("mass").alias("mass"))

    state, k, change = start.select(at_seeds.alias("node"), F.lit(1.0).alias("mass")).distinct(), 0, None
    while k < rounds:
        before = state
        for _ in range(min(every, rounds - k)):
            before, k = state, k + 1
            moved = state.join(steps, state["node"] == steps["source"]).select(F.col("target").alias("node"), (F.col("mass") * F.col("probability") * (1 - restart)).alias("mass"))
            state = moved.unionByName(again).groupBy("node").agg(F.sum("mass").alias("mass"))
        if fixed:
            continue
        state = cut(state)
        change = spread(state).withColumnRenamed("mass", "_new").join(spread(before), "node", "full").agg(F.sum(F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0))))).first()[0] or 0.0
        if change <= tolerance:
            break
    return spread(state).select("node", "mass", F.lit(k).alias("rounds"), F.lit(change).cast("double").alias("residual"))


def page_rank_kernel(probabilities: DataFrame, seeds: DataFrame, restart: float = V.RESTART, rounds: int = V.MOST_ROUNDS, tolerance: float = V.TOLERANCE) -> DataFrame:
    """node, mass, rounds and residual of the same, in one task: for graphs of one repository, which fit a worker."""
    steps = probabilities.groupBy("source", "target").agg(F.sum("probability").alias("probability"))
    rows = steps.unionByName(seeds.select(F.lit(None).cast("string").alias("source"), F.col("path").alias("target"), F.lit(None).cast("double").alias("probability")).distinct())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["source"].notna()].sort_values(["source", "target"])
        start = sorted(frame.loc[frame["source"].isna(), "target"])
        names = sorted({*own["source"], *own["target"], *start})
        place = {n: k for k, n in enumerate(names)}
        a, b = (own[c].map(place).to_numpy(dtype=np.int64) for c in ("source", "target"))
        p, first = own["probability"].to_numpy(dtype=np.float64), np.zeros(len(names))
        first[[place[n] for n in start]] = 1.0 / len(start)
        stuck = np.ones(len(names), bool)
        stuck[a] = False
        mass, k, change = first.copy(), 0, np.inf
        while k < rounds and change > tolerance:
            moved = np.bincount(b, weights=mass[a] * p, minlength=len(names))
            new = restart * first + (1 - restart) * (moved + mass[stuck].sum() * first)
            change, mass, k = float(np.abs(new - mass).sum()), new, k + 1
        return pd.DataFrame({"node": names, "mass": mass, "rounds": k, "residual": change})

    return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "node string, mass double, rounds int, residual double")


def max_product(steps: DataFrame, seeds: DataFrame, max_hops: int = 4, decay: float = V.HOP_DECAY, rounds: int | None = None) -> DataFrame:
    """node, score, hops and path (nodes from the seed on) of the best product of weights from a seed (column path), each hop times ``decay``.

    steps: source, target, weight (at most 1). A node goes on only while its best label has fewer than ``max_hops``
    hops, even if a weaker one has. As every step shrinks the score, these labels are the only ones that
    reproduce themselves; every round computes all of them anew from the last, until none changes or for
    ``rounds`` rounds.
    """
    best_steps = steps.groupBy("source", "target").agg(F.max("weight").alias("weight"))
    start = seeds.select(F.col("path").alias("node"), F.lit(1.0).alias("score"), F.lit(0).alias("hops"), F.array("path").alias("path")).distinct()
    labels, k, state = start, 0, None
    while rounds is None or k < rounds:
        k += 1
        went = labels.where(F.col("hops") < max_hops).join(best_steps, F.col("node") == F.col("source"))
        offers = went.select(F.col("target").alias("node"), (F.col("score") * decay * F.col("weight")).alias("score"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("target")).alias("path"))
        best = F.min(F.struct((-F.col("score")).alias("_less"), "hops", "path")).alias("_best")
        labels = start.unionByName(offers).groupBy("node").agg(best).select("node", (-F.col("_best._less")).alias("score"), "_best.hops", "_best.path")
        if rounds is None:
            labels = cut(labels)
            now = labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "score", "hops").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
    return labels


def hop_distances(links: DataFrame, seeds: DataFrame, max_hops: int = 5) -> DataFrame:
    """node and hops: the fewest steps (source, target) from a seed (column path), up to ``max_hops``.

    Only the nodes that were new in a round go on, and the rounds end once there are none.
    """
    ways = links.select("source", "target").distinct()
    layer = cut(seeds.select(F.col("path").alias("node"), F.lit(0).alias("hops")).distinct())
    reached = layer
    for hop in range(1, max_hops + 1):
        went = layer.join(ways, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        layer = cut(went.join(reached, "node", "left_anti").select("node", F.lit(hop).alias("hops")))
        if layer.isEmpty():
            break
        reached = reached.unionByName(layer)
    return reached


def strongest_paths(probabilities: DataFrame, seeds: DataFrame, targets: DataFrame, max_hops: int = 5) -> DataFrame:
    """node, cost and path (nodes from the seed on) of the likeliest simple way to each target (column path) in up to ``max_hops`` steps.

    Each round extends the likeliest way with that many steps to every node. That loses none: if the likeliest way to a target
    led through a node by another way than the likeliest with as many steps, the latter would make a likelier one, without the
    loop that it might close.
    """
    steps = probabilities.where("probability > 0").groupBy("source", "target").agg(F.max("probability").alias("probability"))
    ways = seeds.select(F.col("path").alias("node"), F.lit(0.0).alias("cost"), F.array("path").alias("path")).distinct()
    layers = []
    for _ in range(max_hops):
        went = ways.join(steps, ways["node"] == steps["source"]).where(~F.array_contains("path", F.col("target")))
        went = went.select(F.col("target").alias("node"), (F.col("cost") - F.log("probability")).alias("cost"), F.concat("path", F.array("target")).alias("path"))
        ways = cut(went.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("_best")).select("node", "_best.cost", "_best.path"))
        layers.append(ways)
    found = reduce(DataFrame.unionByName, layers).join(targets.select(F.col("path").alias("node")).distinct(), "node", "left_semi")
    return found.groupBy("node").agg(F.min(F.struct("cost", F.size("path").alias("_size"), "path")).alias("_best")).select("node", "_best.cost", "_best.path")
