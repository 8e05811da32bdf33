"""Session helpers: where intermediate tables may be cut."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished write go at once; by default they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Where none is set, a local session (one process, as in tests) gets a temporary folder; on a cluster that is an error,
    since executors would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: for tables too large for ``cut``."""
    return Scratch(df.sparkSession).staged(df)


class Scratch:
    """Intermediate tables in the shared checkpoint folder, which ``drop`` removes as soon as their readers are done.

    As a context it drops what is left when it ends, by an error too; what is returned from it is to be ``cut`` before.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.paths = spark, {}

    def _path(self) -> str:
        return f"{self.spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"

    @contextmanager
    def _written(self, path: str, name: str | None = None) -> Iterator[None]:
        """A write that fails leaves nothing."""
        try:
            yield
        except BaseException:
            self._remove(path, name)
            raise

    def staged(self, df: DataFrame) -> DataFrame:
        """``df`` written as Parquet and read back."""
        path = self._path()
        with _shuffles_dropped(self.spark), self._written(path):
            df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = back, path, None
        return back

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` written as a table bucketed by ``key``: joins on it don't shuffle it again."""
        path, name = self._path(), f"staged_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with _shuffles_dropped(self.spark), self._written(path, name):
            df.write.option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(name)
        back = self.spark.table(name)
        self.paths[id(back)] = back, path, name
        return back

    def folder(self) -> str:
        """A folder for others to write in, which goes with the rest."""
        path = self._path()
        self.paths[path] = None, path, None
        return path

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that this object wrote; nothing may read them later."""
        for table in tables:
            self._remove(*self.paths.pop(id(table))[1:])

    def _remove(self, path: str, name: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        while self.paths:
            self._remove(*self.paths.popitem()[1][1:])
