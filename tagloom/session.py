"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings every query of this library relies on.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "tagloom", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; on a cluster use the session it gives."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        **conf,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and all run on this machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
        named = context.getCheckpointDir()
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once into the shared folder: cuts the lineage and survives a lost executor.

    The table is removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tagloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, for files that workers write; removed when the driver's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tagloom-{name}-{uuid.uuid4().hex}"
    files, place = fs.FileSystem.from_uri(path)
    files.create_dir(place)
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone already
        pass


def scan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes of ``df``, or the bytes of its texts where it has none; sizes the number of buckets, never the result."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    texts = [F.sum(F.octet_length(f.name)) for f in df.schema if f.dataType.typeName() == "string"]
    return sum(x or 0 for x in df.agg(*texts).first()) if texts else df.count()
