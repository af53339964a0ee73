"""Session set-up, tables in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = SparkSession.builder.master(master).appName("taxaflow").config("spark.driver.memory", memory)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and the master is one local JVM is a
    temporary folder made; on a cluster its absence is an error, as a folder on
    one machine would be lost with that machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    at = tempfile.mkdtemp(prefix="taxaflow-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    return f"file://{at}"


class SharedTables:
    """Intermediate tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop_all)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes ``df`` and reads it again; ``by`` names a column of folders, so that its values can be read alone."""
        path = f"{self.root}/{name}"
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str, schema: T.StructType) -> DataFrame:
        """All tables saved under names that begin with ``name/``, as one."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already
            pass

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def drop_all(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for costly work per row on few or small files.

    Inputs of many files, as all large ones are, have more partitions than that and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def wide(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in as many partitions as shuffles have, or cores there are, even if it is small."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order``, which must leave no ties, from 0 on in column ``name``.

    Rows are sorted by ranges and written once; a row's place is its place in
    its range and the rows of the ranges before it. So a key with many rows is
    many ranges, and only one row per range meets in one task.
    """
    ranges = df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
    rows = SharedTables(df.sparkSession, "numbered").save(ranges, "sorted")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    return rows.join(F.broadcast(start), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, last change) of a table's folder or file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s for s in (fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, "*")) or [])] or [fs.getFileStatus(p)]
    return len(files), sum(s.getLen() for s in files), max(s.getModificationTime() for s in files)


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def small_side(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is.

    The rows are counted up to the limit only; beyond it the planner joins by
    shuffle, with the same result.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
