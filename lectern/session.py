"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, name: str = "lectern", **conf: str) -> SparkSession:
    """A local session as used by the tests and by ``bench.py``; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.maintenanceInterval", "600s")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """What the plans of this package need on any session; calling it again does nothing.

    The numpy kernels and stateful functions run in Python workers, so the package goes to
    them. Two settings are changed, once for a session:

    * Spark 4.1 lets a union report the partitioning its children share. When adaptive execution
      then gives the children different partition counts, the query fails with "Can't zip RDDs
      with unequal numbers of partitions". Without the report a later step that needs the
      partitioning shuffles as in earlier versions.
    * Of a key that stands twice in a JSON object the last value counts, instead of the object
      being unreadable.
    """
    _ship_package(spark)
    for key, value in (("unionOutputPartitioning", "false"), ("variant.allowDuplicateKeys", "true")):
        if spark.conf.get(f"spark.sql.{key}", None) != value:
            spark.conf.set(f"spark.sql.{key}", value)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests on one machine) a new temporary
    folder is made and kept in the session, so every later call sees the same root. On a cluster
    executors could not see each other's folders, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{name}-{os.urandom(6).hex()}")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once below the shared folder and read back.

    Later steps read the files: nothing above is computed twice, and a lost executor costs its own
    tasks only.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
