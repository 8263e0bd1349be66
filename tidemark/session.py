"""Session helpers: builder defaults for tests and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE on, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rsplit("/", 1)[0] if _is_context_dir(held) else held.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-shared-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def _is_context_dir(path: str) -> bool:
    """Spark appends a UUID folder to the directory it was given."""
    try:
        uuid.UUID(path.rstrip("/").rsplit("/", 1)[1])
    except (ValueError, IndexError):
        return False
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the reliable checkpoint folder; later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def enough_tasks(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, dealt over more tasks if it has fewer input splits than there are cores.

    Work in Python on a few unsplittable files would leave most cores idle. Such an input is no larger than that few
    splits, so dealing it out is cheap; a larger one is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores // 2 else df.repartition(cores)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with its file system's scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
