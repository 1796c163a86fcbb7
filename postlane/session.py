"""Session, table access and lineage cutting."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "postlane") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("POSTLANE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(max(8, cores)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FORGOTTEN: set[str] = set()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in ``spark.checkpoint.dir``; a local session without one uses a folder beside its warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        sc.setCheckpointDir(shared)
    own = sc._jsc.sc().getCheckpointDir().get()
    if own not in _FORGOTTEN:
        # the application's own folder in the shared one; it goes when the application ends
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FORGOTTEN.add(own)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written into the shared folder; unlike a checkpoint it is compressed and its size is known to the planner."""
    return stage(df, "cut")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for tables written between the stages of one query."""
    _ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once into the shared folder and read it back; columnar, pruned on reading."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
