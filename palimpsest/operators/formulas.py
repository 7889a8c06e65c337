"""Laws of mass, orbits, gates and memberships as column expressions, and reports over scored attachments.

Each law is a pure projection, so it stays inside whole-stage code generation; reports are one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize

# Rates of a mass update, range and bend of an orbit's radius, share of context in a skill's score.
EVIDENCE_RATE, UTILITY_RATE, CONFLICT_RATE = 0.10, 0.15, 0.50
RADIUS_LEAST, RADIUS_MOST, RADIUS_BEND = 1.0, 10.0, 1.25
SKILL_FLOOR, SKILL_CONTEXT = 0.35, 0.65
# Base weights of the write-energy law; redundancy and risk count against a write, high risk forbids it.
WRITE_ENERGY = {"utility": 1.5, "novelty": 1.0, "explicit": 1.8, "impact": 1.5, "confidence": 0.7, "redundancy": -0.9, "risk": -1.8}
RISK_VETO = 0.82


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def updated_mass(mass: Column, independent_sources: Column, utility: Column, conflict: Column) -> Column:
    """Mass after new evidence: repeats of a known source add nothing, conflict takes mass away."""
    return _clip(mass + EVIDENCE_RATE * F.log1p(independent_sources) + UTILITY_RATE * utility - CONFLICT_RATE * conflict)


def orbit_radius(mass: Column) -> Column:
    """Bounded radius, falling with mass; it orders like mass and must not be added to a score."""
    return RADIUS_LEAST + (RADIUS_MOST - RADIUS_LEAST) * F.pow(1.0 - _clip(mass), F.lit(RADIUS_BEND))


def may_merge(similarity: Column, compatible: Column, same_scope: Column, threshold: float) -> Column:
    return (similarity >= threshold) & compatible & same_scope


def may_consolidate(evidence: Column, coherence: Column, conflict: Column, diversity: Column, least_evidence: int = 2, least_coherence: float = 0.55, most_conflict: float = 0.30, least_diversity: float = 0.35) -> Column:
    return (evidence >= least_evidence) & (coherence >= least_coherence) & (conflict <= most_conflict) & (diversity >= least_diversity)


def write_energy(features: dict[str, Column]) -> Column:
    """Weighted sum of the features; missing ones count 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(features.get(k, F.lit(0.0)), F.lit(0.0)) for k, w in WRITE_ENERGY.items()])


def may_write(features: dict[str, Column], threshold: float) -> Column:
    return (write_energy(features) > threshold) & (F.coalesce(features["risk"], F.lit(0.0)) < RISK_VETO)


def beta_bound(successes: Column, failures: Column, z: float) -> Column:
    """Mean of the Beta posterior less z of its standard deviations."""
    a, b = successes + 1.0, failures + 1.0
    n = a + b
    return a / n - z * F.sqrt(a * b / (n * n * (n + 1.0)))


def skill_score(successes: Column, failures: Column, context: Column, z: float = 1.0) -> Column:
    return beta_bound(successes, failures, z) * (SKILL_FLOOR + SKILL_CONTEXT * context)


def crowd_corrected(score: Column, members: Column, zeta: float) -> Column:
    """A cluster's activation without the advantage of its size."""
    return score - zeta * F.log1p(members)


def merge_score(similarity: Column, overlap: Column, conflict: Column) -> Column:
    """How well two clusters go together."""
    return 0.50 * similarity + 0.35 * overlap - 0.65 * conflict


def soft_memberships(scored: DataFrame, key: str, cluster: str, logit: str, temperature: float = 0.8, keep: int = 3, least: float = 0.03) -> DataFrame:
    """(key, cluster, probability, place): the ``keep`` likeliest clusters of each row under a softmax, from ``least`` on.

    ``scored`` has one row per (key, cluster). Null logits do not count. Ties go to the lesser cluster.
    """
    rows = scored.where(F.col(logit).isNotNull())
    by = Window.partitionBy(key)
    e = F.exp((F.col(logit) - F.max(logit).over(by)) / F.lit(temperature))
    rows = rows.withColumn("_e", e)
    rows = rows.select(key, cluster, F.round(F.col("_e") / F.sum("_e").over(by), 6).alias("probability"))
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.col("probability").desc(), cluster)))
    return rows.where((F.col("place") <= keep) & (F.col("probability") >= least))


def attachment_report(scored: DataFrame, key: str, score: str, truth: str, threshold: float, top_k: int = 3) -> DataFrame:
    """One row: recall, contamination, false attachment and abstention of rows with no true cluster, coverage, mean attachments.

    A row attaches to its ``top_k`` best clusters whose score reaches the threshold. Ties at the same score share a place.
    """
    place = F.rank().over(Window.partitionBy(key).orderBy(F.col(score).desc()))
    rows = scored.select(key, (F.col(truth).cast("int")).alias("t"), ((F.col(score) >= threshold)).alias("ok"), place.alias("p"))
    rows = rows.withColumn("s", (F.col("ok") & (F.col("p") <= top_k)).cast("int"))
    per = rows.groupBy(key).agg(F.sum("t").alias("true"), F.sum("s").alias("picked"), F.sum(F.col("t") * F.col("s")).alias("hit"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.when(b > 0, b), F.lit(0.0)), 6)
    closed, opened = F.col("true") > 0, F.col("true") == 0
    share = lambda good, among: ratio(F.count_if(good & among), F.count_if(among))
    return per.agg(
        ratio(F.sum("hit"), F.sum("true")).alias("recall"), ratio(F.sum(F.col("picked") - F.col("hit")), F.sum("picked")).alias("contamination"),
        share(F.col("picked") > 0, opened).alias("open_false_attachment"), share(F.col("picked") == 0, opened).alias("open_abstention"),
        share(F.col("hit") > 0, closed).alias("coverage"), F.round(F.avg("picked"), 6).alias("mean_attachments"),
    )


def two_means(points: DataFrame, group: str, id_col: str, vector: str, rounds: int = 15) -> DataFrame:
    """(group, balance, separation, within, split_score) of two-means clusters of each group's vectors.

    The first centre is the vector of the least id, the second the one farthest from it; rounds end when no vector
    moves. Centres are two rows per group, means come from partial aggregates, so a hot group is no single task.
    Groups of one vector have score 0.
    """
    rows = materialize(points.where(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")), "two_means")
    distance = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    first = rows.groupBy("g").agg(F.min_by("v", "i").alias("c0"))
    far = rows.join(first, "g").groupBy("g").agg(F.max_by("v", F.struct(distance(F.col("v"), F.col("c0")), -F.col("i"))).alias("c1"))
    centres = materialize(first.join(far, "g"), "two_means_centres")
    changed = None
    for _ in range(rounds):
        side = (distance(F.col("v"), F.col("c1")) < distance(F.col("v"), F.col("c0"))).cast("int")
        means = rows.join(centres, "g").groupBy("g", side.alias("s")).agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
        both = means.groupBy("g").agg(F.max(F.when(F.col("s") == 0, F.col("m"))).alias("m0"), F.max(F.when(F.col("s") == 1, F.col("m"))).alias("m1"))
        new = centres.join(both, "g").select("g", F.coalesce("m0", "c0").alias("n0"), F.coalesce("m1", "c1").alias("n1"), "c0", "c1")
        new = materialize(new.withColumn("moved", distance(F.col("n0"), F.col("c0")) + distance(F.col("n1"), F.col("c1")) > 1e-12), "two_means_centres")
        changed = not new.where("moved").isEmpty()
        centres = new.select("g", F.col("n0").alias("c0"), F.col("n1").alias("c1"))
        if not changed:
            break
    near = F.least(distance(F.col("v"), F.col("c0")), distance(F.col("v"), F.col("c1")))
    side = distance(F.col("v"), F.col("c1")) < distance(F.col("v"), F.col("c0"))
    out = rows.join(centres, "g").groupBy("g").agg(
        F.count_if(side).alias("b"), F.count_if(~side).alias("a"), F.avg(near).alias("within"), F.max(distance(F.col("c0"), F.col("c1"))).alias("separation")
    )
    balance = F.least("a", "b") / F.greatest("a", "b")
    return out.select(F.col("g").alias(group), balance.alias("balance"), "separation", "within", (balance * F.col("separation") / F.greatest(F.lit(0.05), F.col("within"))).alias("split_score"))


def record_bytes(rows: Column, dimensions: Column, edges: Column) -> dict[str, Column]:
    """Bytes of half-precision vectors, and of state (96) and edges (24 each) besides them."""
    return {"vector_bytes": rows * dimensions * 2, "state_bytes": rows * 96, "edge_bytes": edges * 24}


def activation_spread(edges: DataFrame, start: DataFrame, weights: dict[str, float], eta: float = 0.3, steps: int = 3) -> DataFrame:
    """(node, activation) after some steps of spreading along typed edges.

    ``edges`` has src, dst, kind and weight; each kind is normalized by itself per source, so that many weak edges of one
    kind do not drown a strong one of another; a negative kind weight inhibits. Weights of a kind that sum up to 0 have
    no shares: NaN goes where an active source sends them. ``start`` has node and base. Each step is
    a sparse product, one join and one sum; activations below 0 are cut.
    """
    by = Window.partitionBy("src", "kind")
    theta = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], F.lit(kv[1])), weights.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
    own, total = theta * F.col("weight"), F.sum("weight").over(by)
    share = F.coalesce(F.try_divide(own, total), own * float("inf"))  # 0 / 0 is NaN, as in SQL, and no error
    flow = materialize(edges.select("src", "dst", share.alias("p")).where("p <> 0"), "flow")
    base = materialize(start.groupBy("node").agg(F.sum("base").alias("base")), "spread_base")
    now = base.select("node", F.col("base").alias("a"))
    for _ in range(steps):
        moved = now.join(flow, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("a") * F.col("p")).alias("m"))
        both = base.join(moved, "node", "full")
        a = F.greatest(F.lit(0.0), (1 - eta) * F.coalesce("base", F.lit(0.0)) + eta * F.coalesce("m", F.lit(0.0)))
        now = materialize(both.select("node", a.alias("a")), "spread")
    return now.select("node", F.col("a").alias("activation"))
