"""Mixing sources to target shares of tokens, along a time-varying curriculum.

The weight of a source changes over training time t in [0, 1] as share x (1 + ramp x (2t - 1)); ramps are balanced so
that all weights sum to 1 at any time. Its integral, the cumulative demand share x (t + ramp x (t^2 - t)), is inverted
at the cumulative tokens of each document, which gives the document's training position; the mix is sorted by range of
position. Cumulative tokens come from sums per hash bucket, so that no task sees more than one bucket of a source; the
buckets of a source grow in number with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialize


@dataclass(frozen=True)
class MixConfig:
    """steepness: how far the most repeatable source rises from half to twice its mean (0: constant weights)."""

    steepness: float = 0.6
    bucket_rows: int = 50_000  # documents of a source that one task sums up, about
    seed: int = 5
    total_tokens: int | None = None  # None: as many as the scarcest source allows


def source_plan(sized: DataFrame, targets: DataFrame, cfg: MixConfig) -> list[dict]:
    """Per listed source: available tokens, tokens wanted, ramp. One row per target, so the driver holds few rows."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats")
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    rows = [r.asDict() for r in wanted.join(have, "source", "left").collect()]
    live = [r for r in rows if r["tokens"] and r["repeats"] > 0]
    whole = sum(r["share"] for r in live)
    for r in live:
        r["part"] = r["share"] / whole
    total = min((r["tokens"] * r["repeats"] / r["part"] for r in live), default=0)
    if cfg.total_tokens is not None:
        total = min(total, cfg.total_tokens)
    lean = {r["source"]: r["repeats"] for r in live}
    mean = sum(r["part"] * lean[r["source"]] for r in live)
    spread = max((abs(v - mean) for v in lean.values()), default=0)
    for r in rows:
        if "part" in r:
            r["want"], r["ramp"] = r["part"] * total, (cfg.steepness * (lean[r["source"]] - mean) / spread if spread else 0.0)
        else:
            r["want"], r["ramp"] = 0.0, 0.0
    return rows


def mix_sources(sized: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(position, source, doc_id, copy, n_tokens), sorted by range of position, a training time in [0, 1].

    ``sized`` has doc_id, source and n_tokens. Source names are compared without case and outer blanks. Documents
    without tokens or of sources that are not listed are not drawn; a listed source without documents gets nothing and
    the others keep their proportions. The mix is the largest in which every source that has documents reaches its
    share and no document is taken more than max_repeats times; every document of a source is taken once before any is
    repeated. The last document of a source is taken if its middle is still wanted. Repeated rows count once.
    """
    sized = sized.where((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull() & F.col("source").isNotNull())
    sized = materialize(sized.select("doc_id", F.lower(F.trim("source")).alias("source"), "n_tokens").dropDuplicates(["doc_id"]), "mix_sizes")
    spark = sized.sparkSession
    # buckets are the first bits of the hash by which documents are ordered, so their number changes no result
    bits = lambda n: max(1, min(40, (max(1, n // cfg.bucket_rows)).bit_length()))
    listed = source_plan(sized, targets, cfg)
    rows = [(r["source"], float(r["want"]), int(r["tokens"]), float(r["ramp"]), -int(-r["want"] // r["tokens"]), 64 - bits(r["documents"])) for r in listed if r["want"] > 0]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, want double, tokens long, ramp double, epochs long, shift int"))
    keyed = sized.join(plan, "source").withColumn("h", F.xxhash64(F.lit(cfg.seed), "doc_id")).withColumn("bucket", F.expr("shiftright(h, shift)"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("s").over(ahead), F.lit(0))).drop("s")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.join(sums, ["source", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    copies = keyed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    middle = F.col("copy") * F.col("tokens") + F.col("before") + F.col("n_tokens") / 2
    copies = copies.withColumn("q", middle / F.col("want")).where("q < 1")
    r, q = F.col("ramp"), F.col("q")
    time = F.when(F.abs(r) < 1e-9, q).otherwise((r - 1 + F.sqrt((1 - r) * (1 - r) + 4 * r * q)) / (2 * r))
    mixed = copies.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), time)).alias("position"), "source", "doc_id", "copy", "n_tokens")
    return mixed.orderBy("position", "source", "doc_id", "copy")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies): one row per listed source."""
    by = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).groupBy("source")
    by = by.agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("c").alias("most_copies"))
    whole = by.agg(F.sum("tokens").alias("whole"))
    goal = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = goal.join(by, "source", "left").crossJoin(F.broadcast(whole))
    return joined.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("reached_share"), z("tokens"), z("documents"), z("most_copies"))
