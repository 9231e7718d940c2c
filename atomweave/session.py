"""Session helpers: local sessions for tests and benchmarks, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "atomweave") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_LOCAL: list[str] = []  # the folder of this process, where no shared one is set
_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only in a local session without the setting (tests, a laptop) is a fresh local folder used.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    local = context.master.startswith("local[") or context.master == "local"
    if folder:
        default = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if not local and "://" not in folder and not folder.startswith("file:"):
            if default.startswith("file:"):  # the cluster's own word that all its machines see this folder
                return "file://" + os.path.abspath(folder)
            return default.rstrip("/") + "/" + folder.lstrip("/")  # readers that do not ask Hadoop find it too
        return folder
    if not local:
        raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, so far unused path below the shared folder; :func:`drop_staged` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete all that this process has staged so far; results that still read it must be done with."""
    jvm, conf, count = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches of a plan read into the shared folder and read it back.

    This cuts the lineage: the branches scan columns of the written table instead of repeating what
    leads to it, the planner knows its real size, and a lost executor costs a re-read only.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
