"""Learned scores and reports of answers: online gate, pairwise reranker, weighted logistic orbit model, recall of capsules.

Folds whose order matters (the gate, the reranker) run over a bounded list of feedback rows on the driver and give weights,
which score any number of rows as column expressions. Models of whole tables are fitted by MLlib.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.answers import word_form
from palimpsest.operators.lifecycle import GATE_BIAS, GATE_WEIGHTS

#: Fields of the pairwise reranker, in order.
RERANK_FIELDS = ["semantic", "overlap", "containment", "identifier", "polarity", "length_fit", "pairs"]
# Answers that say nothing.
ABSTENTIONS = ["unknown", "i don't know", "不知道", "无法回答"]


def learned_gate(feedback: list[tuple[list[float], bool]], weights: list[float] | None = None, bias: float = GATE_BIAS, rate: float = 0.035, decay: float = 0.0015, bound: float = 4.0) -> tuple[list[float], float]:
    """Weights and bias of the write gate after feedback (nine features, useful) in order: logistic steps with decay, bounded."""
    w = np.array(list(GATE_WEIGHTS.values()) if weights is None else weights, float)
    for features, useful in feedback:
        x = np.asarray(features, float)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ w + bias)))))
        error = float(useful) - p
        w = np.clip(w + rate * (error * x - decay * w), -bound, bound)
        bias = max(-bound, min(bound, bias + rate * error))
    return w.tolist(), float(bias)


def gate_probability(fields: dict[str, Column], weights: list[float], bias: float) -> Column:
    return T.bounded_sigmoid(reduce(lambda a, kv: a + F.lit(kv[1]) * fields[kv[0]], zip(GATE_WEIGHTS, weights), F.lit(bias)))


def rerank_fields(query: str, text: str, semantic: Column) -> dict[str, Column]:
    """The seven fields of a question and a text; columns by name, semantic from any encoder."""
    q, t = T.memory_tokens(query), T.memory_tokens(text)
    ids = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[A-Za-z]+[-_.:/]?\d+(?:\.\d+)*"), F.lit(0))
    plain = lambda x: F.array_join(x, " ")
    negated = lambda x: reduce(lambda a, b: a | b, [F.contains(plain(x), F.lit(c)) for c in ("not", "never", "不", "没")])

    def pairs(x: Column) -> Column:
        n = F.greatest(F.size(x) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)))
    return {
        "semantic": F.greatest(F.lit(0.0), semantic), "overlap": T.jaccard(q, t), "containment": share(q, t), "identifier": F.arrays_overlap(ids(query), ids(text)).cast("double"),
        "polarity": (negated(q) == negated(t)).cast("double"), "length_fit": F.exp(-F.abs(F.size(q) - F.size(t)) / F.greatest(F.lit(4), F.size(q) + F.size(t))), "pairs": share(pairs(q), pairs(t)),
    }


@dataclass
class PairwiseReranker:
    """A small network over the seven fields, taught by pairs of a useful and a rejected text; weights stay within 2."""

    seed: int = 38017
    w1: np.ndarray = field(init=False)
    b1: np.ndarray = field(init=False)
    w2: np.ndarray = field(init=False)
    b2: float = 0.0

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.w1, self.b1, self.w2 = r.normal(0.0, 0.18, (7, 10)), np.zeros(10), r.normal(0.0, 0.18, 10)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        h = np.tanh(x @ self.w1 + self.b1)
        return h, 1 / (1 + math.exp(-max(-20.0, min(20.0, float(h @ self.w2 + self.b2)))))

    def learn(self, useful: list[float], rejected: list[list[float]], rate: float = 0.025, most: int = 12) -> float:
        """One step for each rejected text, ``most`` at most; returns the mean loss."""
        up, losses = np.asarray(useful, float), []
        for down in (np.asarray(x, float) for x in rejected[:most]):
            (hu, su), (hd, sd) = self._forward(up), self._forward(down)
            m = max(-20.0, min(20.0, su - sd))
            pull, back = -1 / (1 + math.exp(m)), self.w2.copy()
            du, dd = pull * back * (1 - hu * hu), -pull * back * (1 - hd * hd)
            self.w2 = np.clip(self.w2 - rate * pull * (hu - hd), -2, 2)
            self.w1 = np.clip(self.w1 - rate * (np.outer(up, du) + np.outer(down, dd)), -2, 2)
            self.b1 = self.b1 - rate * (du + dd)
            losses.append(math.log1p(math.exp(-m)))
        return sum(losses) / max(1, len(losses))

    def score(self, fields: dict[str, Column]) -> Column:
        """The network as one expression, so that scoring stays in the JVM."""
        x = [fields[k] for k in RERANK_FIELDS]
        hidden = [F.tanh(reduce(lambda a, kv: a + F.lit(float(kv[0])) * kv[1], zip(self.w1[:, j], x), F.lit(float(self.b1[j])))) for j in range(10)]
        z = reduce(lambda a, kv: a + F.lit(float(kv[0])) * kv[1], zip(self.w2, hidden), F.lit(float(self.b2)))
        return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z))))


def fit_orbit_model(rows: DataFrame, features: str, label: str, hard: Column | None = None):
    """Logistic model of attachments by MLlib: positives are weighed up to balance, hard negatives count four times.

    ``features`` is an array of doubles, ``label`` 0 or 1; ``hard`` tells negatives that look alike. Returns the model.
    """
    n = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    up = n.n / max(1, n.p)
    weight = F.when(F.col(label) == 1, up).otherwise(1.0 + 3.0 * F.coalesce(hard, F.lit(False)).cast("double") if hard is not None else F.lit(1.0))
    data = rows.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("w"))
    return LogisticRegression(weightCol="w", maxIter=60, regParam=1e-4).fit(data)


def blended(df: DataFrame, group: str, old: str, new: str, weight: float) -> Column:
    """(1 - weight) of the old and weight of the new score, each brought to [0, 1] within its group; flat scores are 0."""
    w = Window.partitionBy(group)

    def unit(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    return (1 - weight) * unit(old) + weight * unit(new)


def balanced_temperature(df: DataFrame, logit: str, label: str, grid: list[float]) -> DataFrame:
    """(temperature, score): the temperature of the least Brier score where both classes count half; ties to the lower one."""
    rows = df.select(F.col(logit).alias("z"), F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    p = 1.0 / (1.0 + F.exp(-F.col("z") / F.col("temperature")))
    g = rows.groupBy("temperature").agg((0.5 * F.avg(F.when(F.col("y") == 1, (p - 1) * (p - 1))) + 0.5 * F.avg(F.when(F.col("y") == 0, p * p))).alias("score"))
    best = g.agg(F.min(F.struct(F.round("score", 9).alias("score"), "temperature")).alias("b"))
    return best.select("b.temperature", "b.score")


def capsule_recall(capsules: DataFrame, gold: DataFrame, query: str, rank: str, sources: str, source: str, ks: list[int]) -> DataFrame:
    """(k, queries, any, full, micro, mrr) of ranked capsules: a source counts at the first capsule that holds it.

    Questions of ``gold`` without capsules count as missed; the reciprocal rank is that of the first capsule with gold.
    """
    g = gold.select(query, F.col(source).alias("s")).where("s is not null").distinct()
    placed = capsules.select(query, F.col(rank).alias("r"), F.explode(sources).alias("s")).groupBy(query, "s").agg(F.min("r").alias("r"))
    j = g.join(placed, [query, "s"], "left")
    per = j.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).groupBy("k", query).agg(F.count(F.lit(1)).alias("gold"), F.count_if(F.col("r") <= F.col("k")).alias("hit"), F.min("r").alias("first"))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), mean((F.col("hit") > 0).cast("double"), "any"), mean((F.col("hit") == F.col("gold")).cast("double"), "full"), F.round(F.sum("hit") / F.sum("gold"), 6).alias("micro"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "mrr"))


def merged_results(parts: DataFrame, weight: str, keys: list[str], means: list[str]) -> DataFrame:
    """Means of partial results, weighed by what they were taken over; parts of no weight add nothing."""
    total = F.sum(weight)
    return parts.where(F.col(weight) > 0).groupBy(*keys).agg(total.alias(weight), *[(F.sum(F.col(m) * F.col(weight)) / total).alias(m) for m in means])


def answer_report(cases: DataFrame) -> DataFrame:
    """One row over answered cases: exact, token_f1, evidence_recall, grounded, abstention.

    ``cases`` has prediction, answer, answerable, evidence (ids), hits (ids retrieved) and citations (ids). Unanswerable
    cases are right if the prediction is empty or says that it is unknown.
    """
    words = lambda c: F.split(F.nullif(word_form(F.coalesce(c, F.lit(""))), F.lit("")), " ")
    p, r = F.coalesce(words("prediction"), F.array().cast("array<string>")), F.coalesce(words("answer"), F.array().cast("array<string>"))
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    same = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, w: a + F.least(count(p, w), count(r, w)))
    f1 = F.when((F.size(p) == 0) | (F.size(r) == 0), (F.size(p) == F.size(r)).cast("double")).otherwise(2.0 * same / (F.size(p) + F.size(r)))
    ok = F.col("answerable")
    share = lambda a, b, empty: F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a)).otherwise(empty)
    silent = (F.size(p) == 0) | F.lower(F.trim(F.coalesce("prediction", F.lit("")))).isin(ABSTENTIONS)
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), mean(F.when(ok, (F.array_join(p, " ") == F.array_join(r, " ")).cast("double")).otherwise(0.0), "exact"), mean(F.when(ok, f1).otherwise(0.0), "token_f1"),
        mean(share(F.col("evidence"), F.col("hits"), F.lit(1.0)), "evidence_recall"), mean(share(F.col("citations"), F.col("hits"), (~ok).cast("double")), "grounded"), mean(F.when(~ok, silent.cast("double")), "abstention"),
    )


def token_estimate(rows: DataFrame, prompt: Column, output: int) -> DataFrame:
    """One row: questions, input and output tokens by a quarter of the characters, median and 95th place of the input."""
    t = rows.select(F.greatest(F.lit(1), F.ceil(F.length(prompt) / 4)).alias("t")).where("t is not null")
    return t.agg(
        F.count(F.lit(1)).alias("questions"), F.sum("t").alias("input_tokens"), (F.count(F.lit(1)) * output).alias("output_tokens"),
        F.expr("percentile(t, 0.5)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by t)").alias("p95"),
    )


def best_option(options: DataFrame, query: str, option: str, semantic: Column, lexical: Column, fit: Column) -> DataFrame:
    """(query, option): the answer option that memory and question fit best, ties to the first."""
    s = options.withColumn("_s", F.round(0.58 * semantic + 0.27 * lexical + 0.15 * fit, 9))
    return s.groupBy(query).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(option).alias("o"))).alias("b")).select(query, F.col("b.o").alias(option))
