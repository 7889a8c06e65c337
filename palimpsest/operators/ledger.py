"""Event ledgers: folds into the live state, censuses over several groupings, periods and numeric answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_DAYS = 30


def census(df: DataFrame, category: str, at: str, value: str) -> DataFrame:
    """Counts and sums of one pass over several groupings: category alone, by month, by week of the month, by window.

    Windows have 30 days and start at the earliest time of all rows. ``level`` names the grouping; the period columns
    of the others are null. Null values count as rows and add nothing.
    """
    start = df.agg(F.min(at).alias("_start"))
    rows = df.join(F.broadcast(start), F.lit(True)).select(
        F.col(category).alias("category"), F.date_format(at, "yyyy-MM").alias("month"), (F.floor((F.dayofmonth(at) - 1) / 7) + 1).cast("int").alias("week"),
        F.floor(F.datediff(F.col(at), F.col("_start")) / WINDOW_DAYS).cast("int").alias("period"), F.col(value).alias("_v"),
    )
    sets = rows.groupingSets([["category"], ["category", "month"], ["category", "month", "week"], ["category", "period"]], "category", "month", "week", "period")
    g = sets.agg(F.count(F.lit(1)).alias("rows"), F.sum("_v").alias("total"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 7, "category").when(F.col("_g") == 3, "month").when(F.col("_g") == 1, "week").otherwise("window")
    return g.select(level.alias("level"), "category", "month", "week", "period", "rows", "total")


def live_state(df: DataFrame, keys: list[str], order: list[str], ends: Column, value: str) -> DataFrame:
    """(keys, value, origin, changes): what each key holds after all its events; ended keys are left out.

    The origin of a value is the first event since the key was last ended: running counts of ends cut the events of a
    key into lives. Only keys whose last event is no end are live.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_end", ends.cast("int")).withColumn("_life", F.coalesce(F.sum("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = rows.groupBy(*keys, "_life").agg(
        F.max_by(F.struct("_end", value), F.struct(*order)).alias("_last"), F.min_by(F.struct(*order), F.struct(*order)).alias("_first"), F.count_if(F.col("_end") == 0).alias("changes")
    )
    last = g.groupBy(*keys).agg(F.max_by(F.struct("_last", "_first", "changes"), "_life").alias("x"))
    return last.where("x._last._end = 0").select(*keys, F.col(f"x._last.{value}").alias(value), F.col(f"x._first.{order[0]}").alias("origin"), "x.changes")


def argmax_period(df: DataFrame, group: list[str], period: str, value: str) -> DataFrame:
    """(group, period, value): the period of the greatest sum of each group, ties to the earlier period."""
    s = df.groupBy(*group, period).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*group).orderBy(F.round("_s", 6).desc(), period)
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*group, period, F.col("_s").alias(value))


def json_leaves(df: DataFrame, id_col: str, json: str, depth: int | None = None) -> DataFrame:
    """(id, path, value): the leaves of a JSON column with dotted, indexed paths; null and empty leaves do not count.

    Variants are opened level by level in the JVM until nothing is nested, or down to ``depth`` levels; what lies deeper
    then comes out as JSON text. Text that is no JSON has no leaves.
    """
    view = f"leaves_{id(df)}"
    df.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null").createOrReplaceTempView(view)
    spark = df.sparkSession
    level, out, i = spark.sql(f"SELECT id, '' AS path, v FROM {view}"), None, 0
    while True:
        name = f"{view}_{i}"
        level.selectExpr("id", "path", "v", "schema_of_variant(v) AS kind").createOrReplaceTempView(name)
        nested = "(kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%')" if depth is None or i < depth else "false"
        leaf = spark.sql(f"SELECT id, path, try_variant_get(v, '$', 'string') AS value FROM {name} WHERE NOT {nested}")
        out = leaf if out is None else out.unionByName(leaf)
        if nested == "false" or spark.sql(f"SELECT 1 FROM {name} WHERE {nested}").isEmpty():
            break
        level = spark.sql(
            f"SELECT id, CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END AS path, e.value AS v"
            f" FROM {name}, LATERAL variant_explode(v) e WHERE {nested}"
        )
        i += 1
    return out.where(F.col("value").isNotNull() & (F.col("value") != "")).select(F.col("id").alias(id_col), "path", "value")
