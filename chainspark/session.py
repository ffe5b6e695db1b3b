"""Session helper for local runs and tests; a cluster brings its own session and settings."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", app: str = "chainspark") -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    n = 8 if cpus == "*" else int(cpus)
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(n))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.local.dir", scratch)
             .config("spark.sql.warehouse.dir", scratch + "/warehouse")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal few rows that open into many over all tasks.

    A number of partitions is given, since their bytes would have them merged into one task before they open.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for derived tables: the one the cluster names; a scratch folder only in local mode.

    A machine-local folder would be useless to executors, so a cluster without the setting is an
    error rather than a silent fallback.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return "file:" + _OWN[0]


def is_written(spark: SparkSession, path: str) -> bool:
    """True when a table was written to the path completely and is still there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


_PART: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder of derived tables inside the shared one."""
    return "/".join([f"{shared_dir(spark)}/chainspark-{spark.sparkContext.applicationId}", *_PART])


@contextlib.contextmanager
def scratch_part(name: str):
    """Derived tables written inside the block go to a part of their own, to be dropped together."""
    _PART.append(name)
    try:
        yield
    finally:
        _PART.pop()


def drop_scratch(spark: SparkSession, part: str = "") -> None:
    """Remove the derived tables of this application, or a part of them.

    They belong to the application: call this when the results that were made from them are
    written, since frames that read them are of no use afterwards.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{part}".rstrip("/"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a derived table to the shared folder and read it back.

    Used for small tables that several branches of a plan read (block ranks, replicate results,
    rounds of a fixpoint): they are computed once, and losing an executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
