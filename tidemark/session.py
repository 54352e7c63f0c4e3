"""Session settings the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings for correct dates and adaptive plans; sizes stay the cluster's choice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local benchmark, with a checkpoint folder of its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def stage_base(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir; beside the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-stages"
    return base.rstrip("/")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder under the shared one."""
    return f"{stage_base(spark)}/{prefix}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder in spark.checkpoint.dir, so lost executors cost a re-read.

    Where none is named the folder lies beside the warehouse, which executors share, too.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark, "checkpoint"))
    return df.checkpoint()


#: Spark's setting by which the shuffle files of a job go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of jobs inside leave the executors' disks when each ends."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Stages:
    """Stage tables of one job that go as soon as they are read.

    A lost executor costs a re-read of the last tables. The shuffle files of a stage leave the executors' disks when it is
    written; what is left of others goes with the garbage of the driver's JVM, which each stage has collected."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths, self._tables = spark, {}, {}

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a stage; of tables with one name free() deletes the last. by: rows are dealt into buckets by that column, so that
        later joins on it move the other side only."""
        spark = self._spark
        path = self._paths[name] = shared_folder(spark, f"stage-{name}")
        with shuffles_go(spark):
            writer = df.write.option("compression", "zstd")
            if by is None:
                writer.parquet(path)
            else:
                self._tables[name] = f"llm_{uuid.uuid4().hex}"
                writer = writer.format("parquet").option("path", path)
                writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(self._tables[name])
        files, place = self._at(path)
        files.deleteOnExit(place)
        gc.collect()
        spark._jvm.System.gc()
        return spark.read.schema(df.schema).parquet(path) if by is None else spark.table(self._tables[name])

    def free(self, *names: str) -> None:
        """Delete tables that nothing reads again."""
        for name in names:
            self._free(name)

    def _free(self, name: str) -> None:
        if name in self._tables:
            self._spark.sql(f"drop table {self._tables.pop(name)}")
        files, place = self._at(self._paths.pop(name))
        files.delete(place, True)

    def _at(self, path: str):
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._spark._jsc.hadoopConfiguration()), place

    def names(self) -> list[str]:
        """Names of the tables that are left."""
        return list(self._paths)

    def close(self) -> None:
        """Delete all tables that are left."""
        self.free(*self.names())
