"""Session helpers: checkpoint location and bounded side inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side input is pinned (read once, then broadcast) only up to this many rows.
PIN_LIMIT = 10_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named (tests), a folder of this application on the default
    file system is taken. On several machines that file system must be shared:
    a local one is refused, since each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        default = sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if default.startswith("file:") and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{default.rstrip('/')}/tmp/tallyweave/{sc.applicationId}"
        if default.startswith("file:"):
            named = f"file:///tmp/tallyweave/{sc.applicationId}"
        _delete_on_exit(spark, named)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove ``path`` when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    For rows that several operators scan: each then reads only its own columns,
    and a lost executor costs a re-read, not the whole lineage. The table lives
    as long as the application: the driver removes it at its exit.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    _delete_on_exit(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, *over: DataFrame) -> None:
    """Give back the disk of steps that are over: shuffle files that nothing refers to, and the settled tables ``over``.

    Spark removes shuffle files once the driver has collected what refers to them, which may come too late. The
    tables must not be read again.
    """
    for df in over:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if not path.rsplit("/", 1)[-1].startswith("settled-"):
                raise ValueError(f"not a settled table: {path}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._jvm.System.gc()


def pin(df: DataFrame, limit: int = PIN_LIMIT) -> DataFrame:
    """Fix a small side input as a broadcast literal table.

    At most ``limit + 1`` rows are read. Within the limit the side is computed
    once and broadcast; beyond it the frame is returned as it is and the join
    strategy is left to Catalyst and AQE, so results never depend on the size.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
