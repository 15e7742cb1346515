"""Session helpers: table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it there is an error. Only on a single machine
    (tests) a temporary folder is made and remembered in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    Cuts the lineage, so that several consumers do not recompute it and a lost executor costs
    nothing but its running tasks. Columnar and compressed, unlike an RDD checkpoint.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._written_to = where
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        where = getattr(df, "_written_to", None)
        if where:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else without.

    The count is bounded (``limit``), so checking a large side stays cheap.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    Only an input of fewer partitions (one small file) is shuffled, so that work on long texts does not run in one
    task; a large input keeps its scan partitions and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` with its columns as they are, which later filters and expressions no longer look into.

    A filter on a computed column is otherwise moved towards the scan and what it computes repeated there for each use
    of it. The columns pass through a generator of one row, which nothing that uses them is moved below.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.array(row)))


def distinct_rows(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` without repeated rows, for tables with long texts of which few rows are repeated.

    Only hashes of all rows are shuffled, and whole those rows that share their hash with another one. Where more
    than ``max_rows`` hashes are shared, all rows are shuffled as ``distinct`` does.
    """
    df = spread(df)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    name = "_" * (1 + max(map(len, df.columns), default=0))  # longer than any column's name
    counts = df.select(h.alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    shared = materialize(counts.filter("n > 1").select(name))
    if shared.limit(max_rows + 1).count() > max_rows:
        return df.distinct()
    tagged, shared = df.withColumn(name, h), F.broadcast(shared)
    once = tagged.join(shared, name, "left_anti").drop(name)
    return once.union(tagged.join(shared, name, "left_semi").drop(name).distinct())
