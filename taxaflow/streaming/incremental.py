"""Operators over streams of files: each micro-batch goes through the same functions as a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxaflow.operators import orphans


#: Parts of an upserted table by a hash of its keys. A batch writes again only the parts it touches.
PARTS = 64


def upsert_stream(spark: SparkSession, incoming: str, table: str, keys: list[str], order: str, schema: str, parts: int = PARTS) -> StreamingQuery:
    """Parquet files arriving in ``incoming`` upserted into ``table``, a folder of numbered versions of its parts.

    A batch reads and writes the parts that its keys fall into. A version is
    written whole before the marker moves on, so a batch that is run again after
    a loss gives the same version. Of each part the version before the last is
    kept for that, older ones are removed. ``parts`` belongs to the table: it
    must stay as it was when the table was made.
    """

    def batch(df: DataFrame, number: int) -> None:
        rows = df.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]  # at most ``parts``
        old = _parts(spark, table, number - 1)
        before = [old[p][-1] for p in touched if p in old]
        if before:
            rows = rows.unionByName(spark.read.option("basePath", table).parquet(*before).select(*rows.columns))
        kept = rows.groupBy("_part", *keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("_part", "r.*")
        kept.write.mode("overwrite").partitionBy("_part").parquet(f"{table}/v{number:09d}")
        for p in touched:
            for path in old.get(p, [])[:-1]:
                _delete(spark, path)

    return (
        spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", f"{table}/_progress").trigger(availableNow=True).start()
    )


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _parts(spark: SparkSession, table: str, upto: int | None = None) -> dict[int, list[str]]:
    """Of each part its folders in all complete versions up to a number, oldest first."""
    fs, p = _fs(spark, table)
    out: dict[int, list[str]] = {}
    if not fs.exists(p):
        return out
    for name in sorted(s.getPath().getName() for s in fs.listStatus(p)):
        _, v = _fs(spark, f"{table}/{name}")
        if name.startswith("v") and (upto is None or int(name[1:]) <= upto) and fs.exists(_fs(spark, f"{table}/{name}/_SUCCESS")[1]):
            for part in (s.getPath().getName() for s in fs.listStatus(v)):
                if part.startswith("_part="):
                    out.setdefault(int(part[6:]), []).append(f"{table}/{name}/{part}")
    return out


def latest(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame | None:
    """The table after its last complete version, or after one before the last; None if there is none."""
    paths = [p[-1] for p in _parts(spark, table, upto).values()]
    return spark.read.parquet(*paths) if paths else None


def degree_stream(spark: SparkSession, incoming: str, schema: str, window: str = "30 days", late: str = "60 days") -> DataFrame:
    """Streaming counts of edges per window and type; edges later than the watermark are dropped by it."""
    e = spark.readStream.schema(schema).parquet(incoming)
    e = e.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    return e.groupBy(F.window("loaded_at", window), F.upper(F.trim("type")).alias("type")).agg(F.count("*").alias("edges"))


def orphan_batches(state: orphans.OrphanState, edges: list[DataFrame], parents: list[DataFrame]) -> DataFrame:
    """Feeds arriving batches of edges and node rows to the orphan state; gives all orphans so far."""
    for e, p in zip(edges, parents, strict=True):
        state.step(orphans.references(e), orphans.versions(p))
    return state.orphans()
