"""Session helpers: building a session and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings that make the default plans skew- and size-aware at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "floe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is.  Only
    when it is unset and the master is local (tests) a private folder is created and
    registered; elsewhere that is an error, so ``DataFrame.checkpoint()`` works everywhere.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="floe-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder, released with the ``Scope`` around the call, if any."""
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/floe-{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, and lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCOPES: list[Scope] = []


class Scope:
    """Owner of what the library keeps: written intermediates and persisted frames.

    ``with Scope(spark) as kept: ...`` removes the folders written inside and unpersists the
    frames given to ``keep`` at its end; results that read them must be consumed before.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.frames = spark, [], []

    def keep(self, df: DataFrame) -> DataFrame:
        """Persist ``df`` (memory and disk) until the scope ends."""
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[-1]

    def give(self, paths: list[str]) -> None:
        """Leave ``paths`` to the scope around this one, or to the caller."""
        self.paths = [p for p in self.paths if p not in paths]
        outer = _SCOPES[:_SCOPES.index(self)]
        if outer:
            outer[-1].paths += paths

    def release(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *exc) -> None:
        _SCOPES.remove(self)
        self.release()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
