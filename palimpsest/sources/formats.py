"""Readers and sinks: JSON, JSON lines, CSV, Parquet, ORC, Arrow files, nested dialogues, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """A table of one of the kinds json (one document), jsonl, csv (header), parquet, orc, arrow.

    Malformed rows become null rows instead of failing the scan. An Arrow file or stream is read by the executor that
    gets its path.
    """
    if kind == "arrow":
        return _read_arrow(spark, path, schema)
    r = spark.read
    if schema:
        r = r.schema(schema)
    if kind == "json":
        return r.option("multiLine", True).json(path)
    if kind == "jsonl":
        return r.json(path)
    if kind == "csv":
        # blanks around values are part of them
        return r.options(header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return r.format(kind).load(path)


def _read_arrow(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    if not schema:
        raise ValueError("an Arrow source needs its schema")

    def run(batches):
        import io

        import pyarrow as pa

        for b in batches:
            for raw in b.column("content").to_pylist():
                try:
                    reader = pa.ipc.open_file(io.BytesIO(raw))
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    parts = pa.ipc.open_stream(io.BytesIO(raw))
                yield from parts

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def write_any(df: DataFrame, path: str, kind: str) -> None:
    """Write a table as one of the kinds of read_any except json and arrow; a folder that exists is an error."""
    w = df.write.mode("errorifexists")
    if kind == "jsonl":
        w.json(path)
    elif kind == "csv":
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        w.format(kind).save(path)


def dialogue_turns(df: DataFrame, keep: list[str], sessions: Column) -> DataFrame:
    """(keep, session, turn, role, text) of nested sessions of turns, an array of arrays of (role, content).

    Empty sessions and turns without content have no rows.
    """
    s = df.select(*keep, F.posexplode(sessions).alias("session", "_turns"))
    t = s.select(*keep, "session", F.posexplode("_turns").alias("turn", "_t"))
    return t.where(F.col("_t.content").isNotNull()).select(*keep, "session", "turn", F.col("_t.role").alias("role"), F.col("_t.content").alias("text"))


def even_sample(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``limit`` rows at even positions of the order, first and last included; all rows if there are no more.

    Positions come from counts per range of the order, so that no task numbers the whole table.
    """
    if limit < 1:
        return df.limit(0)
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.orderBy("_pid")  # one row per partition
    start = sizes.withColumn("_start", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    at = parts.join(F.broadcast(start), "_pid").withColumn("_at", F.col("_start") + F.col("_mid") - F.col("_first"))
    if limit == 1:
        return at.where("_at = 0").select(*df.columns)
    step = (F.col("_all") - 1) / F.lit(float(limit - 1))
    near = F.round(F.col("_at") / F.when(step > 0, step).otherwise(1.0))
    hit = (F.col("_all") <= limit) | (F.bround(near * step) == F.col("_at"))
    return at.where(hit).select(*df.columns)


def first_per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def write_snapshot(df: DataFrame, path: str, revision: int) -> str:
    """Write a new, never overwritten revision of a table and return its folder; readers pick one by number."""
    at = f"{path}/revision={revision}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(at)
    return at


def read_snapshot(spark: SparkSession, path: str, revision: int | None = None) -> DataFrame:
    """A revision of a table, by default the newest; the partition column prunes all others from the scan."""
    df = spark.read.parquet(path)
    if revision is None:
        revision = df.agg(F.max("revision")).first()[0]
    return df.where(F.col("revision") == revision).drop("revision")


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the work list that the checkpoint table does not hold yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
