"""Session settings and the shared folder used for anything that must outlive a task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "versespan", cpus: int | str = "*",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators are written for.

    On a cluster the session comes from the submitter; AQE (on by default) is the only
    setting the plans lean on, for run-time join choice and for splitting skewed joins.
    """
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared folder (``spark.checkpoint.dir``).

    Where that is unset, as in tests on one machine, a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("versespan.test.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="versespan-")
        spark.conf.set("versespan.test.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


class Files:
    """The folder operations of the file system a path lies in, wherever that is."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; nothing if it is not there."""
        if not self._system.exists(self._path(folder)):
            return []
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        stream = self._system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Make a small file appear whole, or fail if there is one of its name."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        stream = self._system.create(self._path(draft), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if self._system.exists(self._path(path)) or not self._system.rename(
                self._path(draft), self._path(path)):
            self.remove(draft)
            raise FileExistsError(path)

    def remove(self, path: str) -> None:
        self._system.delete(self._path(path), True)


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is needed more than once and must not be computed twice (a model
    call), or where its true size should steer the next join.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
