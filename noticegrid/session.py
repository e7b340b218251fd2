"""Session settings and the few physical-plan helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Runtime SQL settings every operator relies on. All timestamps are naive UTC.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Settings of registry queries where the session names none of its own.
REGISTRY_CONF = {
    # Columns of few values take 10 to 30 times their room in a file once they are rows, and a table that is
    # broadcast passes through the driver as rows. So this multiple of a file is held against Spark's limit.
    "spark.sql.sources.fileCompressionFactor": "20.0",
    # A task that sums or sorts holds its partition's rows as such; these bound it, whatever the input.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def ship(spark: SparkSession) -> None:
    """Give the workers this package as a zip that Spark itself distributes, once an application."""
    context = spark.sparkContext
    if getattr(context, "_noticegrid_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="noticegrid-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "noticegrid.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(path)
    context._noticegrid_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session created elsewhere (driver, notebook, test); ship the package."""
    ship(spark)
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def prepare_registry(spark: SparkSession) -> SparkSession:
    """``prepare`` for queries over the registry's tables; what the session has set itself stays."""
    for key, value in REGISTRY_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return prepare(spark)


def local_session(cpus: str = "*", app: str = "noticegrid", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.maxPartitionBytes", "64m")
    )
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh path in the folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting only a single-JVM session gets a folder of its own, which goes when it
    ends; on a cluster each executor would write to its own disk, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_noticegrid_root", None)
        if root is None:
            root = spark.sparkContext._noticegrid_root = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = "/".join([root.rstrip("/"), *parts, uuid.uuid4().hex])
    stages = spark.sparkContext.__dict__.setdefault("_noticegrid_stages", [])
    stages.append(path)
    return path


def clear_stages(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application has written, once their results are used."""
    stages = spark.sparkContext.__dict__.setdefault("_noticegrid_stages", [])
    count, jvm = len(stages), spark.sparkContext._jvm
    tables = spark.sparkContext.__dict__.setdefault("_noticegrid_tables", [])
    while tables:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop()}")
    while stages:
        path = jvm.org.apache.hadoop.fs.Path(stages.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, so it survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, "stage")
    df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files go when it ends and not when the driver's memory is next cleared.

    For steps that write their results and never run the same DataFrame again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles it, where it grows with the input but Spark takes it for small.

    Spark counts an array as one element, so rows after an explode, or with arrays, are many times as large
    as it holds against the limit for a broadcast.
    """
    return df.hint("merge")


def bucketed(df: DataFrame, key: str, buckets: int, *order: str) -> DataFrame:
    """``df`` as a staged table in ``buckets`` by a hash of ``key``, which joins on ``key`` need not shuffle.

    Rows that are already in ``buckets`` partitions by that key become one file a bucket. The name in
    the session's catalog only tells Spark of the buckets; ``clear_stages`` drops it with the files.
    """
    spark = df.sparkSession
    name = f"noticegrid_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, "stage")).bucketBy(buckets, key)
    (writer.sortBy(*order) if order else writer).saveAsTable(name)
    spark.sparkContext.__dict__.setdefault("_noticegrid_tables", []).append(name)
    return spark.table(name)


def previous_in_group(df: DataFrame, key: str, order: list[str], value: str, out: str, *, partitions: int | None = None) -> DataFrame:
    """``lag(value)`` per key, however large a key is.

    Rows are range-partitioned on (key, order), so a hot key spreads over many ranges; each range
    computes its own lag and only one row per (range, key) takes part in the stitching window.
    ``order`` must be a total order.
    """
    parts = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(
        df.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()), "zstd"
    )
    last = (
        ranged.groupBy(key, "_range")
        .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")))
        .select(key, "_range", "_carry")
    )
    inner = Window.partitionBy(key, "_range").orderBy(*order)
    return (
        ranged.withColumn("_first", F.row_number().over(inner) == 1)
        .withColumn("_lag", F.lag(value).over(inner))
        .join(last, [key, "_range"])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry.v")).otherwise(F.col("_lag")))
        .drop("_range", "_first", "_lag", "_carry")
    )


def dense_ids(df: DataFrame, key: Column, start: int, out: str = "id", hex_digits: int = 3) -> DataFrame:
    """Consecutive ids from ``start + 1`` in the order of ``key``'s SHA-256, without a global sort.

    ``key`` must be unique. Rows fall into 16**hex_digits even buckets by hash prefix, 65,536 at
    most; the bucket counts (a table of that fixed size) give each bucket its offset. The rows are
    shuffled once, with the hash as bytes, and staged with their rank and without it.
    """
    if not 1 <= hex_digits <= 4:
        raise ValueError("hex_digits must be from 1 to 4")
    digest = F.sha2(key.cast("string"), 256)
    hashed = df.withColumns({"_h": F.unhex(digest), "_b": F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("int")})
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    ranked = materialise(hashed.withColumn("_rn", rank).drop("_h"), "zstd")
    counts = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16**hex_digits rows: one window task and one broadcast of proven size.
    offsets = counts.select(
        "_b",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    return (
        ranked.join(F.broadcast(offsets), "_b")
        .withColumn(out, (F.lit(start) + F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_b", "_rn", "_off")
    )
