"""Relation graphs between the sections of a sample, their components, cliques and consistent clusters.

Sections are numbered from 0 within a sample, at most a few dozen by an earlier
top-m cut; pairs are formed within a sample only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import rank_by

LABELS = ("contradiction", "neutral", "entailment")
#: With more sections than this, cliques are searched by branching and not by listing subsets.
MASK_NODES = 10


def section_pairs(sections: DataFrame) -> DataFrame:
    """All pairs i < j of a sample's sections; columns of each side with suffix _i and _j."""
    a = sections.select("sample_id", *[F.col(c).alias("i" if c == "idx" else f"{c}_i") for c in sections.columns if c != "sample_id"])
    b = sections.select("sample_id", *[F.col(c).alias("j" if c == "idx" else f"{c}_j") for c in sections.columns if c != "sample_id"])
    return a.join(b, "sample_id").filter(F.col("i") < F.col("j"))


def average_relations(scored: DataFrame) -> DataFrame:
    """scored (sample_id, i, j, ent_ij, neu_ij, con_ij, ent_ji, neu_ji, con_ji) with p_ent, p_neu, p_con, both directions' mean, and label, the first of the largest in the order of LABELS."""
    mean = lambda k: ((F.col(f"{k}_ij") + F.col(f"{k}_ji")) / 2).alias(f"p_{k}")
    out = scored.select("*", mean("ent"), mean("neu"), mean("con"))
    top = F.greatest("p_con", "p_neu", "p_ent")
    return out.withColumn("label", F.when(F.col("p_con") == top, LABELS[0]).when(F.col("p_neu") == top, LABELS[1]).otherwise(LABELS[2]))


def relation_edges(relations: DataFrame, alpha: float = 1.0, beta: float = 1.0, clamp: bool = True, e_min: float = 0.5, margin: float = 0.15, tau: float = 0.25, edge_rule: str = "avg", dir_margin: float = 0.0, signed: bool = False) -> DataFrame:
    """(sample_id, i, j, weight) of the pairs that pass the gates; weight = alpha * entailment - beta * contradiction.

    Weights are zero at least, unless signed, and with clamp one at most; a weight of
    tau is an edge. edge_rule "both_dir" also asks each direction for dir_margin.
    """
    gate = (F.col("p_ent") >= e_min) & (F.col("p_ent") - F.col("p_con") >= margin)
    if edge_rule == "both_dir":
        gate &= (F.col("ent_ij") - F.col("con_ij") >= dir_margin) & (F.col("ent_ji") - F.col("con_ji") >= dir_margin)
    w = alpha * F.col("p_ent") - beta * F.col("p_con")
    w = w if signed else F.greatest(F.lit(0.0), w)
    w = F.least(F.lit(1.0), w) if clamp else w
    return relations.filter(gate).select("sample_id", "i", "j", w.alias("weight")).filter(F.col("weight") >= tau)


def label_counts(relations: DataFrame) -> DataFrame:
    return relations.groupBy("sample_id").agg(*[F.count(F.when(F.col("label") == x, 1)).alias(x) for x in LABELS])


def components(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """(sample_id, idx, component): component is the least idx reachable in the sample.

    Up to 62 sections what a section reaches is a bit mask: all masks of a sample are
    taken through each section in turn, in one row. Beyond, reachable pairs double
    their path length with each self-join within a sample.
    """
    if max_nodes <= 62:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))
        own = nodes.select("sample_id", "idx", bit(F.col("idx")).alias("n"))
        both = edges.select("sample_id", F.col("i").alias("idx"), bit(F.col("j")).alias("n")).union(edges.select("sample_id", F.col("j").alias("idx"), bit(F.col("i")).alias("n")))
        near = own.union(both).groupBy("sample_id", "idx").agg(F.bit_or("n").alias("near"))
        rows = near.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "near"))).alias("near"))  # max_nodes at most
        through = lambda masks, k: F.transform(masks, lambda m: F.when(m.bitwiseAND(bit(k)) != 0, m.bitwiseOR(F.coalesce(F.get(masks, k), F.lit(0).cast("long")))).otherwise(m))
        masks = F.transform(F.sequence(F.lit(0), F.lit(max_nodes - 1)), lambda i: F.coalesce(F.try_element_at("near", i), F.lit(0).cast("long")))
        reached = rows.select("sample_id", F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(max_nodes - 1)), masks, through)).alias("idx", "mask"))
        low = F.col("mask").bitwiseAND(-F.col("mask"))
        return reached.filter("mask <> 0").select("sample_id", "idx", F.bit_count(low - 1).cast("int").alias("component"))
    paths = nodes.select("sample_id", F.col("idx").alias("a"), F.col("idx").alias("b")).union(edges.select("sample_id", "i", "j")).union(edges.select("sample_id", "j", "i"))
    for _ in range(max(1, (max(max_nodes, 2) - 1).bit_length())):
        x, y = paths.alias("x"), paths.alias("y")
        paths = x.join(y, (F.col("x.sample_id") == F.col("y.sample_id")) & (F.col("x.b") == F.col("y.a"))).select(F.col("x.sample_id").alias("sample_id"), F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return paths.groupBy("sample_id", F.col("a").alias("idx")).agg(F.min("b").alias("component"))


def _neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bit = lambda c: F.call_function("shiftleft", F.lit(1), F.col(c).cast("int"))
    both = edges.select("sample_id", F.col("i").alias("idx"), bit("j").alias("n")).union(edges.select("sample_id", F.col("j").alias("idx"), bit("i").alias("n")))
    near = both.groupBy("sample_id", "idx").agg(F.bit_or("n").alias("near"))
    return nodes.select("sample_id", "idx").join(near, ["sample_id", "idx"], "left").select("sample_id", "idx", bit("idx").alias("own"), F.coalesce("near", F.lit(0)).alias("near"))


def maximal_cliques(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> DataFrame:
    """(sample_id, members): every maximal clique, single sections too, members ascending.

    Up to MASK_NODES sections every subset is a bit mask: it is a clique if each member
    is next to all others, and maximal if no section is next to all of it. Beyond,
    a branching search runs for each sample.
    """
    if max_nodes > MASK_NODES:
        return _branching_cliques(nodes, edges)
    rows = _neighbours(nodes, edges)
    sizes = rows.groupBy("sample_id").agg((F.max("idx") + 1).alias("m"))
    masks = sizes.select("sample_id", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.col("m").cast("int")) - 1)).alias("mask"))
    inside = masks.join(rows, "sample_id").filter(F.col("mask").bitwiseAND(F.col("own")) != 0)
    whole = inside.groupBy("sample_id", "mask").agg(F.max(F.col("mask").bitwiseAND(F.bitwise_not(F.col("near").bitwiseOR(F.col("own"))))).alias("missing"), F.min(F.col("mask").bitwiseAND(F.bitwise_not(F.col("near").bitwiseOR(F.col("own"))))).alias("missing_low"), F.bit_and("near").alias("common"))
    found = whole.filter((F.col("missing") == 0) & (F.col("missing_low") == 0) & (F.col("common").bitwiseAND(F.bitwise_not("mask")) == 0))
    members = F.filter(F.sequence(F.lit(0), F.lit(max_nodes - 1)), lambda v: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), v)) != 0)
    return found.select("sample_id", members.alias("members"))


def _cogrouped(sections: DataFrame, edges: DataFrame):
    """Both by sample; the edges' columns are named anew, as they often come from the sections."""
    e = edges.select(F.col("sample_id").alias("edge_sample_id"), *[F.col(c).alias(c) for c in edges.columns if c != "sample_id"])
    return sections.groupBy("sample_id").cogroup(e.groupBy("edge_sample_id"))


def _branching_cliques(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        near = {int(v): set() for v in n["idx"]}
        for i, j in zip(e["i"].tolist(), e["j"].tolist(), strict=True):
            near[i].add(j), near[j].add(i)
        found, todo = [], [(frozenset(), frozenset(near), frozenset())]
        while todo:  # each open branch: chosen, can be added, was tried before
            chosen, able, tried = todo.pop()
            if not able:
                if not tried:
                    found.append(sorted(chosen))
                continue
            pivot = max(able | tried, key=lambda v: len(near[v] & able))
            for v in sorted(able - near[pivot]):
                todo.append((chosen | {v}, able & near[v], tried & near[v]))
                able, tried = able - {v}, tried | {v}
        return pd.DataFrame({"sample_id": key[0], "members": found})

    return _cogrouped(nodes, edges).applyInPandas(run, "sample_id long, members array<int>")


def clique_clusters(sections: DataFrame, edges: DataFrame, max_nodes: int, max_cluster_size: int = 3, score: str = "similarity", lambda_score: float = 0.7) -> DataFrame:
    """(sample_id, cluster_rank, members, edge_sum, mean_score, final_score) for every maximal clique.

    Of a clique over max_cluster_size, the subset of that size with the largest sum of
    edges counts, then of mean normalised score, then the first in order. final_score
    = lambda * mean_score + (1 - lambda) * mean edge. Different cliques may give equal
    clusters; each stays.
    """
    w = Window.partitionBy("sample_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    strength = sections.select("sample_id", "idx", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0).alias("norm"))
    cliques = maximal_cliques(sections.select("sample_id", "idx"), edges, max_nodes).withColumn("clique", F.array_join(F.transform("members", lambda v: F.lpad(v.cast("string"), 3, "0")), ","))

    def subsets(members):
        level = F.array(F.array().cast("array<int>"))
        for _ in range(max_cluster_size):
            level = F.flatten(F.transform(level, lambda s: F.transform(F.filter(members, lambda v: v > F.coalesce(F.get(s, F.size(s) - 1), F.lit(-1))), lambda v: F.concat(s, F.array(v)))))
        return level

    options = F.when(F.size("members") > max_cluster_size, subsets(F.col("members"))).otherwise(F.array(F.col("members")))
    tried = cliques.select("sample_id", "clique", F.posexplode(options).alias("option", "members"))
    one = tried.select("sample_id", "clique", "option", "members", F.explode("members").alias("idx"))
    scored = one.join(strength, ["sample_id", "idx"]).groupBy("sample_id", "clique", "option", "members").agg(F.avg("norm").alias("mean_score"))
    # An edge is inside an option if both its ends are.
    inside = scored.join(edges, "sample_id", "left").withColumn("own", F.when(F.array_contains("members", F.col("i")) & F.array_contains("members", F.col("j")), F.col("weight")))
    summed = inside.groupBy("sample_id", "clique", "option", "members", "mean_score").agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("edge_sum"))
    best = summed.withColumn("n", rank_by(["sample_id", "clique"], F.desc("edge_sum"), F.desc("mean_score"), F.asc("option"))).filter("n = 1")
    pairs = F.size("members") * (F.size("members") - 1) / 2
    final = F.lit(lambda_score) * F.col("mean_score") + F.lit(1 - lambda_score) * F.when(pairs > 0, F.col("edge_sum") / pairs).otherwise(0.0)
    out = best.withColumn("final_score", final)
    return out.withColumn("cluster_rank", rank_by("sample_id", F.desc("final_score"), F.asc("clique"))).select("sample_id", "cluster_rank", "clique", "members", "edge_sum", "mean_score", "final_score")


def consistency(total: float, n: int) -> float:
    """The mean weight over all pairs; a missing edge counts 0, fewer than two sections too."""
    return 2.0 * total / (n * (n - 1)) if n > 1 else 0.0


def greedy_prune(nodes: list[int], weights: np.ndarray, target: int) -> tuple[list[int], float, list[int]]:
    """Kept nodes (ascending), their consistency and the removed ones in order.

    First, above two and above target nodes, the node goes whose removal raises the
    consistency most, while any does; then, above target, the one that adds least.
    """
    target, kept, removed = max(1, target), list(nodes), []

    def links() -> np.ndarray:
        return weights[np.ix_(kept, kept)].sum(1)

    least = max(target, 2)
    while len(kept) > least:
        own = links()
        total, n = own.sum() / 2, len(kept)
        base, gain, out = consistency(total, n), 0.0, None
        for k in range(n):
            more = consistency(total - own[k], n - 1) - base
            if more > gain + 1e-12:
                gain, out = more, k
        if out is None:
            break
        removed.append(kept.pop(out))
    while len(kept) > target and len(nodes) > least:
        removed.append(kept.pop(int(np.argmin(links()))))
    kept.sort()
    return kept, consistency(links().sum() / 2, len(kept)), removed


def _parts(nodes: list[int], near: dict[int, set[int]]) -> list[list[int]]:
    """Connected components among nodes, each in order of nodes."""
    left, out = dict.fromkeys(nodes), []
    while left:
        todo, part = [next(iter(left))], set()
        while todo:
            v = todo.pop()
            if v in left:
                del left[v]
                part.add(v)
                todo.extend(near[v])
        out.append([v for v in nodes if v in part])
    return out


def consistency_clusters(sections: DataFrame, edges: DataFrame, target_size: int = 3, hybrid_lambda: float = 0.5, strength: str = "strength") -> DataFrame:
    """(sample_id, cluster_rank, type, members, consistency_raw, consistency_norm, section_norm_avg, hybrid_score).

    Components, larger ones first, are pruned to target_size; the removed sections form
    components among themselves, of which those of target_size or more are pruned
    likewise. Consistency and strength are scaled over the sample and blended. Pruning
    is a sequence of choices, so it runs in one function call for each sample.
    """
    lam = min(1.0, max(0.0, hybrid_lambda))

    def run(key, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("idx")
        order = s["idx"].tolist()
        n = max(order, default=-1) + 1
        weights, near = np.zeros((n, n)), {v: set() for v in order}
        for i, j, w in zip(e["i"].tolist(), e["j"].tolist(), e["weight"].tolist(), strict=True):
            weights[i, j] = weights[j, i] = w
            near[i].add(j), near[j].add(i)
        found = []
        for part in sorted(_parts(order, near), key=len, reverse=True):
            kept, score, removed = greedy_prune(part, weights, target_size)
            found.append(("kept", kept, score))
            for again in _parts(removed, near):
                kept, score, _ = greedy_prune(sorted(again) if len(again) <= max(1, target_size) else again, weights, target_size)
                if len(kept) >= max(1, target_size):
                    found.append(("removed", kept, score))
        own = dict(zip(order, s[strength].astype(float).tolist(), strict=True))
        low, high = min(own.values(), default=0.0), max(own.values(), default=0.0)
        least, most = min((x[2] for x in found), default=0.0), max((x[2] for x in found), default=0.0)
        rows = []
        for kind, members, raw in found:
            norm = (raw - least) / (most - least) if most > least else 0.0
            mean = float(np.mean([(own[v] - low) / (high - low) for v in members])) if high > low else 0.0
            rows.append((key[0], kind, members, raw, norm, mean, lam * norm + (1 - lam) * mean))
        rows.sort(key=lambda r: -r[-1])
        return pd.DataFrame([(r[0], k, *r[1:]) for k, r in enumerate(rows, 1)], columns=["sample_id", "cluster_rank", "type", "members", "consistency_raw", "consistency_norm", "section_norm_avg", "hybrid_score"])

    schema = "sample_id long, cluster_rank int, type string, members array<int>, consistency_raw double, consistency_norm double, section_norm_avg double, hybrid_score double"
    return _cogrouped(sections, edges).applyInPandas(run, schema)
