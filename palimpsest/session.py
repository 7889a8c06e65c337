"""Session helpers: table access, shared scratch tables and checkpoints.

Scratch data always lives in the folder the cluster names in ``spark.checkpoint.dir``; only where that is unset
(local tests) is a local folder chosen. A written table cuts lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_scratch: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``base``; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already
        pass


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below the shared checkpoint folder, removed when the application ends."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key not in _scratch:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "palimpsest-scratch")
        _scratch[key] = f"{root.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _scratch[key])
    return _scratch[key]


def materialize(df: DataFrame, name: str = "t", keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and return a scan of it (lineage is cut there).

    Without ``keep_shuffles`` the shuffle files of this write go as soon as it is done, instead of when the driver
    happens to collect its garbage; nothing can read them again, as the write has its own plan."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema: StructType = df.schema
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    if not keep_shuffles:
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if path.startswith(scratch_dir(table.sparkSession)):
            _drop(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove the scratch tables of results that are written by now; later ones get a new folder."""
    path = _scratch.pop(spark.sparkContext.applicationId, None)
    if path:
        _drop(spark, path)


def text_key(col: str, seed: int = 0):
    """64-bit hash of a string column; two seeds give a 128-bit key."""
    return F.xxhash64(F.lit(seed), F.col(col))
