"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

LABEL = "_label"
ROW_ID = "row_id"
GROUP_KEY = "group_key"
COMMAND = "CommandLine"
IMAGE = "SourceImage"


def local_session(cores: str = "8", app: str = "cmdprism") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    active = context.getCheckpointDir()
    if path is None and active is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="cmdprism-")
        atexit.register(shutil.rmtree, path, True)
    if active is None:
        context.setCheckpointDir(path)
    path = path or active.rsplit("/", 1)[0]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder in the shared one."""
    return f"{shared_dir(spark)}/cmdprism/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application wrote to its folder. Results that read them must be saved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cmdprism/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
