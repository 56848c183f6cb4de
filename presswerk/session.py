"""Session helpers: building a local session, and tables in the shared folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 4, app: str = "presswerk", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(2 * cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("spark__driver__memory", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session in one process gets a local one; on a cluster there is none to guess."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="presswerk-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Folders written in this application and not yet cleared.
_written: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. It goes when the driver ends, or with clear()."""
    path = f"{shared_dir(spark)}/presswerk/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the tables written so far; to be called once the results that read them are written. The number of folders deleted."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows once as a table in the shared folder and read them from there.

    This runs a job when it is called. A written table survives the loss of any executor, and
    unlike checkpoint() it is compressed and computes its input once.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context; theirs need not have it installed."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    _shipped.add(context.applicationId)
    folder = Path(tempfile.mkdtemp(prefix="presswerk-ship-"))
    copy = folder / "src" / package.name
    shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "src"))
    shutil.rmtree(folder / "src")
