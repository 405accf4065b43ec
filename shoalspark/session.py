"""Sessions, and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_to_delete: set[str] = set()


def session(name: str = "shoalspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has dots written as double underscores."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only on a local master without that setting."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's shared folder, which is deleted when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_folder(spark)}/core-{sc.applicationId}"
    if folder not in _to_delete:
        _to_delete.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what is there can be marked
        files.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, later passes read the columns they need, and sizes are known to adaptive joins."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` to be joined by a shuffle: for tables of a row a point, cell or section, whose files may be so well packed that they are taken for small and sent through the driver."""
    return df.hint("merge")
