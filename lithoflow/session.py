"""Session helpers: shared checkpoint folder and partition sizing."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir).

    Where the session names none, as in local tests, one is set under the local temporary
    folder; on a cluster with several machines the setting must be given.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "lithoflow-" + uuid.uuid4().hex)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as a table into the shared folder and reads it back; safe when executors are lost.

    A written table cuts the lineage as checkpoint() does, and the optimizer knows its size. Shuffle
    files of the write go when it ends, not when the driver happens to collect its garbage. The tables
    of a process are removed when it ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lithoflow-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def _remove(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone; the folder is temporary
        pass
    _written.clear()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per context, wherever it was imported from."""
    sc = spark.sparkContext
    if getattr(sc, "_lithoflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.dirname(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc._lithoflow_shipped = True  # the executors have the same path
        return
    at = os.path.join(tempfile.mkdtemp(prefix="lithoflow-"), "lithoflow_sources.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("lithoflow", os.path.relpath(path, root)))
    sc.addPyFile(at)
    sc._lithoflow_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartitions input that has fewer splits than the cluster has cores, rows being costly in Python.

    Small compressed files hold much text; one input split would keep one core busy. Larger input keeps
    its splits, so no text is shuffled.
    """
    least = max(df.sparkSession.sparkContext.defaultParallelism, 2)
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def growing(df: DataFrame) -> DataFrame:
    """A side of a join whose size grows with the data: it is merged, never broadcast for its file size."""
    return df.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Removes materialised tables whose readers are all done."""
    for df in tables:
        for path in df.inputFiles()[:1]:
            folder = path.rsplit("/", 1)[0]
            if any(folder.endswith(p.rsplit("/", 1)[-1]) for p in _written):
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
