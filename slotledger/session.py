"""Session settings the ledger relies on, and the one way it cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: instants are UTC and runtime re-planning is on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # packed days are small in bytes and heavy in work: do not merge them into a few tasks
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    return spark


def local_session(cores: int | str = 8, app: str = "slotledger", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        # no Python stack capture per column expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where that setting is missing and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, for tables that a job writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    A private folder is used only where that setting is missing and the master is local.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    cached = df.persist()  # a checkpoint would otherwise compute its input twice
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def spread(df: DataFrame, *columns: str, factor: int = 1) -> DataFrame:
    """Hash-distribute rows that were generated inside few tasks before heavy work on them.

    A number of partitions is given because runtime merging goes by bytes, and generated
    requests are few bytes that stand for much work. ``factor`` asks for more and smaller tasks
    where single groups are heavy.
    """
    n = factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
