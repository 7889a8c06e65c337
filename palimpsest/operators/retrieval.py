"""Hybrid retrieval: fields fused to one force, two-level pruning, directives, episodes, grounding, statement graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.patterns import says
from palimpsest.session import materialize

# Shares of the seven fields of the fused force.
FORCE = {"semantic": 0.34, "lexical": 0.22, "planar": 0.16, "char": 0.08, "entity": 0.08, "temporal": 0.06, "graph": 0.06}
# Families of directives and the words, anywhere in a text, that tell them, in order.
FAMILIES = {
    "format": ["format", "syntax", "markdown", "code block", "格式", "高亮"], "dependencies": ["dependenc", "library", "libraries", "framework", "lightweight", "minimal", "依赖", "轻量", "框架"],
    "response_style": ["concise", "detailed", "bullet", "tone", "reply", "answer", "简洁", "详细", "语气", "回答"], "language": ["english", "chinese", "language", "中文", "英文", "语言"],
    "privacy": ["private", "privacy", "secret", "redact", "隐私", "秘密", "脱敏"], "workflow": ["always", "whenever", "before", "after", "must", "总是", "每次", "之前", "之后", "必须"],
}
# Words of preferences and of instructions, and words that make no topic.
PREFERENCE = """i prefer, my preference, i like, i dislike, i want, keep .. {simple minimal lightweight concise}, minimal dependenc*, lightweight, easy to maintain,
    我偏好, 我喜欢, 我不喜欢, 我希望, 尽量简, 轻量, 少依赖"""
INSTRUCTION = """always, whenever, every time, must, should, do not, don't, please {use* keep* format* answer* reply*}, format *, respond {with in}, answer {with in},
    总是, 每次, 必须, 不要, 请用, 请保持, 回答时, 格式化"""
NO_TOPIC = "always prefer please should must want".split()


def force(fields: dict[str, Column]) -> Column:
    """Weighted sum of the fields; a missing or null field counts 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(fields.get(k, F.lit(0.0)), F.lit(0.0)) for k, w in FORCE.items()])


def directive_role(text: Column | str, kind: Column | None = None) -> Column:
    own = F.when(says(text, PREFERENCE), "preference").when(says(text, INSTRUCTION), "instruction")
    return F.when(kind.isin("instruction", "preference"), kind).otherwise(own) if kind is not None else own


def directive_family(text: Column | str) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.when(F.lit(False), "")
    for name, words in FAMILIES.items():
        out = out.when(F.rlike(low, F.lit("|".join(words))), name)
    two = F.slice(F.filter(T.memory_tokens(text), lambda w: ~w.isin(NO_TOPIC)), 1, 2)
    return out.otherwise(F.when(F.size(two) > 0, F.concat(F.lit("topic:"), F.array_join(two, "_"))).otherwise("general"))


def latest_per_family(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def around(hits: DataFrame, rows: DataFrame, group: str, order: str, radius: int) -> DataFrame:
    """Rows of a hit's group at most ``radius`` places away from it: an equi-join on the places, not a range join."""
    near = hits.select(group, F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius)).alias(order)).distinct()
    return rows.join(near, [group, order], "left_semi")


def grounded(source: Column, evidence: Column) -> Column:
    """The evidence, without regard to case and kinds of space, occurs in the source; empty evidence does not."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((F.trim(evidence) != "") & F.contains(flat(source), flat(evidence)), F.lit(False))


def predicate_slug(value: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9_㐀-鿿]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "related_to").otherwise(slug)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of rows of equal keys whose intervals [start, end) overlap.

    Both sides are cut into cells of ``width``, so that the join is on keys and cell; a pair counts in the cell where
    the later of its starts lies. Columns of the right side get an r_ before their names.
    """
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))
    le = left.where("start < end").withColumn("_cell", F.explode(cells("start", "end")))
    r = right.where("start < end").select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns]).withColumn("_cell", F.explode(cells("r_start", "r_end")))
    both = le.join(r, [*keys, "_cell"]).where((F.col("r_start") < F.col("end")) & (F.col("start") < F.col("r_end")))
    return both.where(F.col("_cell") == F.floor(F.greatest("start", "r_start") / width)).drop("_cell")


def feedback_weights(weights: dict[str, float], useful: dict[str, float], rejected: list[dict[str, float]], rate: float = 0.035) -> dict[str, float]:
    """Weights moved towards the useful row's fields and away from the mean of the rejected ones, each within 0.01 to 0.60."""
    mean = {k: sum(r.get(k, 0.0) for r in rejected) / len(rejected) if rejected else 0.0 for k in weights}
    return {k: min(0.60, max(0.01, w + rate * (useful.get(k, 0.0) - mean[k]))) for k, w in weights.items()}


def cold_candidates(pairs: DataFrame, query_id: str, id_col: str, lexical: Column, entity: Column, state: Column, historical: Column, hot: DataFrame, k: int = 64) -> DataFrame:
    """(query, id, score): the best inactive rows of each question: archived ones, invalidated ones for questions about the past.

    ``pairs`` are questions with the inactive rows they may want, ``hot`` the ids that are active and left out.
    """
    old = state == "invalidated"
    rows = pairs.where((state == "archived") | (old & historical)).join(hot.select(id_col).distinct(), id_col, "left_anti")
    s = F.round(0.62 * lexical + 0.28 * entity + 0.10 * (historical & old).cast("double"), 6)
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), id_col)
    return rows.withColumn("score", s).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(query_id, id_col, "score")


def identity_matches(names: DataFrame, part: str, id_col: str, name: str, kind: str, vector: str, accept: float = 0.86, margin: float = 0.08, near: float = 0.81) -> tuple[DataFrame, DataFrame]:
    """(merged, open): names that are another name of their part, and those too close to two of them to tell.

    Score: 0.58 cosine, 0.22 overlap of trigrams, 0.14 for fitting kinds (empty or unknown ones fit all), 0.06 where one name
    contains the other. A name merges into the lesser id it fits best if it reaches ``accept`` and leads by ``margin``;
    from ``near`` on it is open otherwise. Candidates share a rare trigram (the three rarest of each name), not a part.
    """
    from palimpsest.functions.answers import normalized_text, trigrams
    from palimpsest.operators.vectors import dot

    rows = materialize(names.where(F.col(name).isNotNull()).select(F.col(part).alias("p"), F.col(id_col).alias("i"), F.col(name).alias("n"), F.coalesce(F.lower(kind), F.lit("")).alias("k"), F.col(vector).alias("v"), trigrams(name).alias("g"), normalized_text(name).alias("t")), "identities")
    grams = rows.select("p", "i", F.explode("g").alias("x"))
    df = grams.groupBy("p", "x").agg(F.count(F.lit(1)).alias("d"))
    w = Window.partitionBy("p", "i").orderBy("d", "x")
    keys = grams.join(df, ["p", "x"]).withColumn("r", F.row_number().over(w)).where("r <= 3").select("p", "i", "x")
    pairs = keys.join(grams.withColumnRenamed("i", "j"), ["p", "x"]).where("j < i").select("p", "i", "j").distinct()
    a, b = rows.toDF("p", "i", "na", "ka", "va", "ga", "ta"), rows.toDF("p", "j", "nb", "kb", "vb", "gb", "tb")
    j = pairs.join(a, ["p", "i"]).join(b, ["p", "j"])
    fits = (F.col("ka").isin("", "unknown")) | (F.col("kb").isin("", "unknown")) | (F.col("ka") == F.col("kb"))
    inside = F.contains("ta", F.col("tb")) | F.contains("tb", F.col("ta"))
    s = 0.58 * F.greatest(F.lit(0.0), dot(F.col("va"), F.col("vb"))) + 0.22 * T.jaccard(F.col("ga"), F.col("gb")) + 0.14 * fits.cast("double") + 0.06 * inside.cast("double")
    top = j.select("p", "i", "j", F.round(s, 6).alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("p", "i").orderBy(F.col("s").desc(), "j"))).where("r <= 2")
    g = top.groupBy("p", "i").agg(F.max(F.when(F.col("r") == 1, F.struct("s", "j"))).alias("b"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("s"))), F.lit(0.0)).alias("s2"))
    exact = F.col("b.s") >= 1.0 - 1e-9  # the same name and kind needs no lead
    ok = (F.col("b.s") >= accept) & ((F.col("b.s") - F.col("s2") >= margin) | exact)
    out = g.select(F.col("p").alias(part), F.col("i").alias(id_col), F.col("b.j").alias("same_as"), F.col("b.s").alias("score"), ok.alias("ok"))
    out = materialize(out, "identity_scores")
    return out.where("ok").drop("ok"), out.where(f"not ok and score >= {near}").drop("ok")
