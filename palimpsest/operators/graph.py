"""Graphs over typed edges: paths with decay, two-hop signals, current edges, closures, communities.

Hops are joins with a bounded number of rounds; each round keeps the best ``beam`` paths per start, so that hubs cannot
multiply. Rounds that feed many later ones are written to the shared folder instead of growing one lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import materialize


def current_edges(facts: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last edge of each (keys), by the order columns."""
    rest = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def best_paths(edges: DataFrame, starts: DataFrame, part: str, src: str, dst: str, weight: str, hops: int, decay: float, beam: int) -> DataFrame:
    """(part, start, node, hop, strength, path): best path of each length from each start, without repeated nodes.

    Strength multiplies weight and decay per hop. Each hop keeps the ``beam`` strongest paths of a start, ties by path.
    """
    e = edges.select(F.col(part).alias("_p"), F.col(src).alias("_s"), F.col(dst).alias("_d"), F.col(weight).alias("_w"))
    front = starts.select(part, F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(1.0).alias("strength"), F.array("start").alias("path"))
    out = None
    for hop in range(1, hops + 1):
        step = front.join(e, (F.col(part) == F.col("_p")) & (F.col("node") == F.col("_s"))).where(~F.array_contains("path", F.col("_d")))
        step = step.select(part, "start", F.col("_d").alias("node"), F.lit(hop).alias("hop"), (F.col("strength") * F.col("_w") * decay).alias("strength"), F.concat("path", F.array("_d")).alias("path"))
        per_node = Window.partitionBy(part, "start", "node").orderBy(F.round("strength", 9).desc(), F.array_join("path", ">"))
        per_start = Window.partitionBy(part, "start").orderBy(F.round("strength", 9).desc(), F.array_join("path", ">"))
        step = step.withColumn("_n", F.row_number().over(per_node)).where("_n = 1").withColumn("_b", F.row_number().over(per_start)).where(F.col("_b") <= beam).drop("_n", "_b")
        front = materialize(step, "hop") if hop < hops else step
        out = front if out is None else out.unionByName(front)
    return out


def reach_signal(edges: DataFrame, marks: DataFrame, part: str, src: str, dst: str, weight: str, decay: float = 0.72) -> DataFrame:
    """(part, node, signal): 0.68 x own mark + 0.32 x best mark within two hops, each hop times weight and decay."""
    e = edges.select(F.col(part).alias("p"), F.col(src).alias("s"), F.col(dst).alias("d"), F.col(weight).alias("w"))
    m = marks.select(F.col(part).alias("p"), F.col("node").alias("d"), F.col("mark"))
    one = e.join(m, ["p", "d"]).select("p", "s", (F.col("w") * decay * F.col("mark")).alias("g"))
    two = one.groupBy("p", F.col("s").alias("d")).agg(F.max("g").alias("g")).join(e, ["p", "d"]).select("p", "s", (F.col("w") * decay * F.col("g")).alias("g"))
    best = one.unionByName(two).groupBy("p", "s").agg(F.max("g").alias("g"))
    own = marks.select(F.col(part).alias("p"), F.col("node").alias("s"), "mark")
    joined = best.join(own, ["p", "s"], "full_outer")
    return joined.select(F.col("p").alias(part), F.col("s").alias("node"), F.least(F.lit(1.0), 0.68 * F.coalesce("mark", F.lit(0.0)) + 0.32 * F.coalesce("g", F.lit(0.0))).alias("signal"))


def shared_entity_edges(rows: DataFrame, part: list[str], id_col: str, entities: str, least: float = 0.34, degree: int = 24) -> DataFrame:
    """(part, a, b, weight), a < b: Jaccard similarity of entity sets, at least ``least``, at most ``degree`` edges a row.

    Pairs come from a join on shared entities within a part; an edge stays if both its ends keep it.
    """
    e = rows.select(*part, id_col, F.size(entities).alias("n"), F.explode(entities).alias("entity"))
    a, b = e.select(*part, "entity", F.col(id_col).alias("a"), F.col("n").alias("na")), e.select(*part, "entity", F.col(id_col).alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, [*part, "entity"]).where("a < b").groupBy(*part, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.withColumn("weight", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6)).where(F.col("weight") >= least)
    ends = pairs.select(*part, "a", "b", "weight", F.explode(F.array("a", "b")).alias("_end"))
    w = Window.partitionBy(*part, "_end").orderBy(F.col("weight").desc(), "a", "b")
    kept = ends.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= degree)
    return kept.groupBy(*part, "a", "b", "weight").agg(F.count(F.lit(1)).alias("_k")).where("_k = 2").drop("_k")


def similar_sets(rows: DataFrame, part: str, tokens: str, least: float, left: str, right: str) -> DataFrame:
    """(part, left, right): ordered pairs of rows of one part whose token sets have a Jaccard similarity of ``least`` or more.

    Exact: equal sets are one class, and two classes can only be similar if they share one of their rarest tokens, as many
    as a set may miss and one more (prefix filter). Sets of too different sizes are not compared. ``tokens`` are distinct;
    empty sets are similar to nothing. left and right are structs of the row's columns.
    """
    rows = rows.where(F.size(tokens) > 0).withColumn("_c", F.array_sort(tokens))
    rows = materialize(rows.withColumn("_k", F.sha2(F.array_join("_c", " "), 256)), "sets")
    sets = materialize(rows.groupBy(part, "_k").agg(F.first("_c").alias("_c")), "set_classes")
    words = sets.select(part, "_k", F.explode("_c").alias("_w"))
    rank = words.groupBy(part, "_w").agg(F.count(F.lit(1)).alias("_n"))
    by_rank = words.join(rank, [part, "_w"]).groupBy(part, "_k").agg(F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_o"))
    n = F.size("_o")
    keys = by_rank.select(part, "_k", n.alias("_z"), F.explode(F.slice("_o", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)).alias("_o"))
    keys = materialize(keys.select(part, "_k", "_z", F.col("_o._w").alias("_w")), "set_keys")
    x, y = (keys.select(part, "_w", F.col("_k").alias(f"_k{s}"), F.col("_z").alias(f"_z{s}")) for s in "xy")
    near = x.join(y, [part, "_w"]).where("_kx < _ky").where(F.least("_zx", "_zy") >= F.greatest("_zx", "_zy") * least - 1e-9).select(part, "_kx", "_ky").distinct()
    c = sets.select(part, "_k", "_c")
    near = near.join(c.toDF(part, "_kx", "_cx"), [part, "_kx"]).join(c.toDF(part, "_ky", "_cy"), [part, "_ky"])
    near = materialize(near.where(T.jaccard(F.col("_cx"), F.col("_cy")) >= least).select(part, "_kx", "_ky"), "set_links")
    links = near.unionByName(near.select(part, F.col("_ky").alias("_kx"), F.col("_kx").alias("_ky"))).unionByName(sets.select(part, F.col("_k").alias("_kx"), F.col("_k").alias("_ky")))
    cols = [c for c in rows.columns if c not in (part, "_k", "_c")]
    side = lambda k, name: rows.select(part, F.col("_k").alias(k), F.struct(*cols).alias(name))
    return side("_kx", left).join(links, [part, "_kx"]).join(side("_ky", right), [part, "_ky"]).select(part, left, right)


def connected_components(edges: DataFrame, part: str, src: str, dst: str) -> DataFrame:
    """(part, node, component): the least node reachable.

    Each round hooks every component onto its least neighbour, flattens the chains of hooks by pointer doubling and
    contracts the edges to those between different components. Components with a neighbour at least halve in number, so
    rounds are logarithmic even for a long chain, and finished components are not looked at again. Every round is written
    to the shared folder; no component is gathered in one task.
    """
    named = lambda df, a, b: df.select(F.col(part).alias("p"), F.col(a).alias("u"), F.col(b).alias("v"))
    both = named(edges, src, dst).unionByName(named(edges, dst, src)).where("u <> v").distinct()
    both = materialize(both, "cc_edges")
    label = both.select("p", F.col("u").alias("node"), F.col("u").alias("c")).distinct()
    while True:
        hooks = both.groupBy("p", "u").agg(F.min("v").alias("to")).where("to < u")
        hooks = materialize(hooks, "cc_hooks")
        if hooks.isEmpty():
            return label.select(F.col("p").alias(part), "node", F.col("c").alias("component"))
        while True:
            up = hooks.select("p", F.col("u").alias("to"), F.col("to").alias("higher"))
            step = hooks.join(up, ["p", "to"], "left").select("p", "u", F.coalesce("higher", "to").alias("to"), F.col("higher").isNotNull().alias("moved"))
            step = materialize(step, "cc_hooks")
            hooks = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        at = lambda c: hooks.select("p", F.col("u").alias(c), F.col("to").alias(f"{c}_to"))
        label = materialize(label.join(at("c"), ["p", "c"], "left").select("p", "node", F.coalesce("c_to", "c").alias("c")), "cc_label")
        moved = both.join(at("u"), ["p", "u"], "left").join(at("v"), ["p", "v"], "left").select("p", F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))
        both = materialize(moved.where("u <> v").distinct(), "cc_edges")


def label_propagation(edges: DataFrame, part: str, src: str, dst: str, weight: str, rounds: int = 6) -> DataFrame:
    """(part, node, label): synchronous weighted voting of neighbours, ties to the least label, a fixed number of rounds."""
    both = edges.select(part, F.col(src).alias("u"), F.col(dst).alias("v"), F.col(weight).alias("w"))
    both = both.unionByName(edges.select(part, F.col(dst), F.col(src), F.col(weight)).toDF(part, "u", "v", "w")).where("u <> v").groupBy(part, "u", "v").agg(F.max("w").alias("w"))
    both = materialize(both, "lp_edges")
    label = both.select(part, F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        votes = both.join(label.select(part, F.col("node").alias("v"), "label"), [part, "v"]).groupBy(part, "u", "label").agg(F.round(F.sum("w"), 9).alias("s"))
        w = Window.partitionBy(part, "u").orderBy(F.col("s").desc(), "label")
        label = votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(part, F.col("u").alias("node"), "label")
        if i < rounds - 1:
            label = materialize(label, "lp_round")
    return label
