"""Session helpers: shared folder, materialisation, size-checked broadcast."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables up to this many bytes may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024

_WRITTEN: list[tuple[SparkSession, str]] = []


def spark_session(app: str = "mnemora", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a running session is reused as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one of our own only where that is unset and the
    executors are threads of this process. On a cluster without the setting nothing is written and an error raised."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemora-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/mnemora-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as parquet into the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, gives the optimizer true sizes and lets
    several branches share one computation.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_files(path: str) -> tuple[object, list[str]]:
    """File system and names of the parquet files of a folder, for tasks that read a shared table themselves."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(inside)) if f.path.endswith(".parquet"))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                remove_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            return


#: Bytes in memory of a byte of compressed, column-wise files.
EXPANSION = 4


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size. For files it is their compressed size, and rows that a generator adds are not in it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when df surely is within the limit in memory; otherwise leave the choice to the planner.

    The estimate counts EXPANSION-fold, and a plan with a generator has no estimate to trust: write such a table first.
    """
    if "Generate " in df._jdf.queryExecution().optimizedPlan().toString():
        return df
    return F.broadcast(df) if plan_bytes(df) * EXPANSION <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
