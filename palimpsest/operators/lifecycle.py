"""Life cycle of memories: write gate, decay, retention, conflicts, merging, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import materialize

# Trust by source, half-life in days by kind, and the weights of the write gate.
SOURCE_TRUST = {"user": 0.95, "user_correction": 0.99, "verified_tool": 0.90, "tool": 0.72, "imported": 0.62, "assistant_inference": 0.46, "unknown": 0.40}
HALF_LIFE_DAYS = {"preference": 365.0, "fact": 210.0, "instruction": 120.0, "event": 75.0, "observation": 45.0}
GATE_WEIGHTS = {"explicit": 1.8, "novelty": 0.65, "future_value": 1.1, "correction": 1.35, "source_trust": 1.0, "relation_density": 0.35, "actionability": 0.75, "redundancy": -0.55, "injection_risk": -3.2}
GATE_BIAS, DEFAULT_HALF_LIFE = -0.85, 90.0


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def source_trust(source: Column | str) -> Column:
    return lookup(F.lower(F.trim(source)), SOURCE_TRUST, SOURCE_TRUST["unknown"])


def age_days(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400_000_000.0))


def decay_factor(kind: Column, days: Column) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * days / lookup(kind, HALF_LIFE_DAYS, DEFAULT_HALF_LIFE))


def expiry(created: Column, kind: Column, half_lives: float) -> Column:
    """When a row has lived so many half-lives of its kind."""
    span = (F.lit(half_lives) * lookup(kind, HALF_LIFE_DAYS, DEFAULT_HALF_LIFE) * F.lit(86_400_000_000.0)).cast("long")
    return F.timestamp_micros(F.unix_micros(created) + span)


def decayed(df: DataFrame, now: Column, mass: str = "mass", confidence: str = "confidence", since: str = "updated_at") -> DataFrame:
    """Mass and confidence after the half-life of the kind; pinned rows and rows from the future keep theirs."""
    f = F.when(F.coalesce(F.col("pinned"), F.lit(False)), F.lit(1.0)).otherwise(decay_factor(F.lower(F.trim("kind")), F.coalesce(age_days(now, F.col(since)), F.lit(0.0))))
    moved = f < 1.0
    return df.withColumns({mass: F.when(moved, F.greatest(F.lit(0.03), F.col(mass) * f)).otherwise(F.col(mass)), confidence: F.when(moved, F.greatest(F.lit(0.05), F.col(confidence) * F.sqrt(f))).otherwise(F.col(confidence))})


def nearest_earlier(rows: DataFrame, id_col: str, part: str, at: str, tokens: str, block: int = 512) -> DataFrame:
    """(id, near): the greatest Jaccard similarity of a row's tokens to those of any earlier row of its part.

    ``part`` is one string per scope. Rows of a part are numbered by time and id and cut into blocks; a block meets the
    blocks before it, one pair of blocks in a task, so that a part of any size is spread over many tasks. All earlier
    rows count: the work is quadratic in a part. The first row of a part has none; equal times go by id.
    """
    order = Window.partitionBy(part).orderBy(at, id_col)
    t = rows.select(F.col(id_col).alias("i"), F.xxhash64(part).alias("p"), F.transform(tokens, lambda x: F.xxhash64(x)).alias("t"), F.row_number().over(order).alias("n"))
    t = materialize(t.withColumn("b", F.floor(F.col("n") / block)), "nearest_earlier")
    groups = t.groupBy("p", "b").agg(F.collect_list(F.struct("n", "t")).alias("held"))  # at most ``block`` rows in a cell
    groups = groups.withColumn("last", F.max("b").over(Window.partitionBy("p")))
    sent = groups.withColumn("to", F.explode(F.sequence("b", "last"))).select("p", F.col("to").alias("b"), "held")

    def similarity(row: Column) -> Column:
        both = F.size(F.array_intersect(F.col("t"), row["t"]))
        return F.when((F.size("t") == 0) | (F.size(row["t"]) == 0) | (row["n"] >= F.col("n")), F.lit(0.0)).otherwise(both / (F.size("t") + F.size(row["t"]) - both))

    near = t.join(sent, ["p", "b"]).select("i", F.aggregate("held", F.lit(0.0), lambda best, row: F.greatest(best, similarity(row))).alias("s"))
    return near.groupBy(F.col("i").alias(id_col)).agg(F.max("s").alias("near"))


def write_features(df: DataFrame, text: str, source: str, importance: str, entities: str, nearest: Column) -> DataFrame:
    """Nine features of a write and the gate's probability; nearest is the greatest similarity to what is stored."""
    df = df.withColumn("_tokens", T.memory_tokens(text))  # cut once for all cues
    actions = F.lit(0.0)
    for c in T.ACTION_CUES:
        actions = actions + T.has_cue(text, [c], F.col("_tokens")).cast("double")
    feats = {
        "explicit": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(importance), F.lit(0.0)))),
        "novelty": 1.0 - nearest,
        "future_value": F.when(T.has_cue(text, T.FUTURE_CUES, F.col("_tokens")), 0.55).otherwise(0.0),
        "correction": F.when(T.has_cue(text, T.CORRECTION_CUES, F.col("_tokens")), 1.0).otherwise(0.0),
        "source_trust": source_trust(source),
        "relation_density": F.least(F.lit(1.0), F.size(T.text_entities(text, entities)) / 5.0),
        "actionability": F.least(F.lit(1.0), 0.35 * actions),
        "redundancy": nearest,
        "injection_risk": T.injection_risk(text),
    }
    out = df.withColumns(feats)
    score = F.lit(GATE_BIAS)
    for name, w in GATE_WEIGHTS.items():
        score = score + w * F.col(name)
    return out.withColumn("probability", T.bounded_sigmoid(score)).drop("_tokens")


def retention_score(now: Column, mass: str = "mass", trust: str = "source_trust", utility: str = "utility", updated: str = "updated_at") -> Column:
    recency = F.exp(-age_days(now, F.col(updated)) / 90.0)
    return 0.30 * F.col(mass) + 0.25 * F.col(trust) + 0.25 * F.col(utility) + 0.20 * recency


def over_capacity(df: DataFrame, group: str, id_col: str, score: Column, capacity: int) -> DataFrame:
    """Rows that must leave their group: unpinned ones of the lowest score beyond the capacity, ties by id."""
    ranked = df.withColumn("_s", F.round(score, 6)).withColumn("_pin", F.coalesce(F.col("pinned"), F.lit(False)))
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    low = F.row_number().over(Window.partitionBy(group, "_pin").orderBy("_s", id_col))
    return ranked.withColumn("_n", size).withColumn("_low", low).where(~F.col("_pin") & (F.col("_low") <= F.col("_n") - capacity)).drop("_n", "_low", "_pin")


def bitemporal_visible(df: DataFrame, valid_at: Column, known_at: Column, valid_from: str, valid_to: str, learned: str) -> Column:
    """Known by known_at and valid at valid_at, [valid_from, valid_to)."""
    return (F.col(learned) <= known_at) & (F.col(valid_from).isNull() | (F.col(valid_from) <= valid_at)) & (F.col(valid_to).isNull() | (valid_at < F.col(valid_to)))


def numbers_of(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)))


def conflict(left_text: str, right_text: str) -> Column:
    """Texts of one fact conflict if negation flips or their numbers have nothing in common."""
    flip = T.has_cue(left_text, T.NEGATIONS) != T.has_cue(right_text, T.NEGATIONS)
    a, b = numbers_of(left_text), numbers_of(right_text)
    return flip | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
