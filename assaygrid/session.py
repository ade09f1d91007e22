"""Session defaults and the shared scratch location."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "assaygrid") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a session whose tasks run in this very process (master local or local[...]) may go without
    one; it gets a folder of its own that ends with the process. Elsewhere a folder of this machine
    would lose what other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def _release_at_exit() -> None:
    """Delete what this process has written and not released, where its session still runs."""
    for spark in {id(x[0]): x[0] for x in _WRITTEN}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the session or its JVM has ended, so nothing can be reached any more
            continue


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written between stages; what is not released is deleted when the process ends."""
    if not _WRITTEN:
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that `cut` has written for this session after the first `since`; returns how many.

    Frames that read them are of no use afterwards, so write or collect results first.
    """
    context = spark.sparkContext
    gone = [x for x in _WRITTEN[since:] if x[0] is spark]
    for entry in gone:
        path = context._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(entry)
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables cut inside the block are deleted at its end."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, since)


def cut(df, label: str = "stage"):
    """Write `df` once to the shared folder and read it back, so iterations do not replay it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
