"""Session helpers: a tuned local session, table access and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application.

    Python workers import it by name; where the cluster doesn't have it installed, Spark's
    own file server hands them the archive that the driver makes here.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="kgloom-"), "kgloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "kgloom") -> SparkSession:
    """A session for tests and benches; a cluster brings its own and never calls this."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("KGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scans_only(df: DataFrame) -> bool:
    """Whether the plan has no exchange, so that asking for its partitions runs nothing."""
    stack = [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        if node.nodeName() in ("Aggregate", "Join", "Window", "Sort", "Repartition", "RepartitionByExpression", "Deduplicate", "Distinct", "GlobalLimit", "Intersect", "Except"):
            return False
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return True


def spread(df: DataFrame) -> DataFrame:
    """Enough partitions for all cores before costly work on each row.

    A table of fewer files than cores would keep most of them idle; a larger one, which is
    any at scale, is returned as it is, without a shuffle. A plan that shuffles already is
    left to adaptive execution: asking for its partitions would run it.
    """
    if not _scans_only(df):
        return df
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder of ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset a temporary folder serves a local
    master, whose executors share it; any other master is an error. The files outlive any
    executor, so a lost one costs a re-read and not a recomputation; a local session removes
    them with the frames they belong to (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    ship(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kgloom-"))
    return df.checkpoint(eager=True)
