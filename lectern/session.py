"""Session settings and small plan helpers shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "lectern", partitions: int = 8) -> SparkSession:
    """Session for tests and benches. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by `spark.checkpoint.dir`. Only a local session may go without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys) -> DataFrame:
    """Repartition before an Arrow function.

    The rows are few bytes but much work each, so size-based coalescing would put them in one task; an explicit
    partition count is left alone by adaptive execution.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A Parquet file of one row group is one task, whatever its size: deal such a table over the cores before it is worked on.

    A table that comes in as many parts as there are cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def in_blocks(rows: DataFrame, key: str, n_rows: int, limit: int) -> Iterator[DataFrame]:
    """`rows` in as many parts as keep each near `limit` rows, all of a key together: a part may be sent to every task."""
    n = max(1, -(-n_rows // limit))
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def has_folder(spark: SparkSession, path: str) -> bool:
    """Whether the shared file system has this folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder of the shared file system; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def move_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder of the shared file system; `to` must not be there yet."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(source, target):
        raise FileExistsError(to)
