"""Session helpers shared by all operators: table reading, shared folder, spreading of small inputs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_SHUFFLES = re.compile(r"^[\s:+-]*(?:Aggregate|Join|Repartition\w*|RebalancePartitions|Sort|Distinct|Deduplicate|Window|Intersect|Except)\b", re.M)


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers find this package where it lies, whatever folder the driver was started in.

    The path goes to the workers with each Python stage; on machines without it, ship the package by --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def build_session(app: str = "papyra", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's own session is used."""
    return ship(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAPYRA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name: one Parquet file or a folder of them."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine gets a new temporary folder, dropped at exit; on a cluster that fails.

    Returned as the URI or path that the session names; a fresh subfolder is to be made by the caller.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="papyra-checkpoint-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows when a handful of input splits would leave most of the cores idle.

    Large inputs have at least as many splits as cores and stay as they are, so no shuffle is added there. A frame that
    holds a shuffle is spread by it already; asking for its splits would run it.
    """
    cores = ship(df.sparkSession).sparkContext.defaultParallelism
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()) or df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])
