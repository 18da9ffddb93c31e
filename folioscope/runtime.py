"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank characters: space, tab and both line-break characters.
BLANKS = " \t\r\n"


def session(app: str = "folioscope", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (as in tests) gets a temporary folder that is removed at its end; on a cluster
    that is an error, as no machine's own folder can be read by the others.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="folio-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This job's part of the shared folder; what is written there goes when the driver ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _own:
        folder = f"{shared_folder(spark)}/folio-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _own[sc.applicationId] = folder
    return _own[sc.applicationId]


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and go on from there, without its lineage.

    A table rather than a checkpoint: it is smaller, only the columns that are asked for are read again, and its size is
    known to the optimizer.
    """
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of steps that are over be removed now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def beside(rows: DataFrame, state: DataFrame, keys: list[str], by: str, hot: int = 50_000) -> DataFrame:
    """``rows`` joined with ``state`` (keys, n, ...), one row per key, where n tells how many of ``rows`` the key has.

    Keys of more than ``hot`` rows are parted by a hash of ``by`` into parts of about that size, and their row of ``state`` is
    repeated for each part. The list of such keys has at most one entry per ``hot`` rows; it is broadcast while it is short.
    """
    parts = F.ceil(F.col("n") / F.lit(hot)).cast("int")
    few = state.where(F.col("n") > hot).select(*keys, parts.alias("_parts"))
    few = F.broadcast(few) if few.limit(100_001).count() <= 100_000 else few
    x = rows.join(few, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    y = state.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return x.join(y, [*keys, "_part"]).drop("_part")


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of an input can never clash with working names."""
    return df.select(*[f"`{n}`" for n in names])


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt out over all cores before costly row-wise work, if it has fewer partitions than there are cores.

    A small file, or one of few row groups, is read by few tasks; a large table has tasks enough and isn't shuffled. The rows are the same.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
