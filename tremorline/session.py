"""Session settings, table loading, scratch tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of its files, beyond which a side that is meant to be small is no longer broadcast.
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "tremorline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, one subfolder per application.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in tests on one
    machine, a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so a lost executor costs the tasks it ran and not the whole history,
    and several readers share one computation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table from ``cut`` that its successor has replaced, so that a long iteration keeps one state on disk."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> bool:
    """Delete every scratch table of this application (call it once the results are stored)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    return path.getFileSystem(conf).delete(path, True)


def small_side(df: DataFrame, label: str, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame:
    """``df`` written once, counted and weighed: with a broadcast hint up to ``max_rows`` rows in ``max_bytes`` of files, with a merge hint beyond.

    A merge join shuffles, and adaptive execution splits its skewed partitions.
    """
    table = cut(df, label)
    small = table.count() <= max_rows and file_bytes(table) <= max_bytes
    return F.broadcast(table) if small else table.hint("merge")


def file_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table from ``cut``."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [jvm.org.apache.hadoop.fs.Path(f) for f in {f.rsplit("/", 1)[0] for f in table.inputFiles()}]
    return sum(path.getFileSystem(conf).getContentSummary(path).getLength() for path in folders)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` over ``spark.sql.shuffle.partitions`` tasks, for kernels that need much time per byte.

    Left to itself, adaptive execution would join partitions that are small in bytes and put such a kernel into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "inner", hot_share: float = 1e-4, least: int = 100_000, counts: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with ``small`` (one row per key) without letting a hot key fill one task.

    A key is hot when it holds more than ``max(least, hot_share * rows)`` rows of ``big``, so there are
    at most ``1 / hot_share`` hot keys; their rows of ``small`` are broadcast and the rows of ``big``
    stay where they are. All other keys are joined by shuffle. ``how`` is inner or left.
    ``counts`` may give the rows of ``big`` per key as ``(key, n)``, if they are known.
    """
    counts = big.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = big.count()
    limit = max(least, int(hot_share * total))
    if total <= limit:
        return big.join(small, key, how)
    hot = [r[0] for r in counts.where((F.col("n") > limit) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    warm = big.where(~is_hot).join(small.where(~is_hot), key, how)
    return warm.unionByName(big.where(is_hot).join(F.broadcast(small.where(is_hot)), key, how))
