"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tidelog", **conf: str) -> SparkSession:
    """A session with the defaults that the operators are tested with."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the cluster's `spark.checkpoint.dir`. Only where that is unset and the master is this
    machine alone, as in tests, a folder of this machine is made and noted as the session's
    checkpoint folder; on a cluster without the setting that would lose data, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/tidelog/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder of the shared root; no two calls get the same one. The application's end removes it."""
    sc, own = spark.sparkContext, _own_folder(spark)
    if getattr(sc, "_tidelog_folder", None) != own:
        sc._tidelog_folder = own
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), own)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


def _remove(jvm, hadoop, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    except Exception:  # the JVM may be gone; the folder then waits for the cluster's own clearing
        pass


def cut(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per context, by way of the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.join("tidelog", os.path.relpath(at, here)))
    path = shared_path(spark, "code") + "/tidelog.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(packed.getvalue())
    finally:
        out.close()
    sc.addPyFile(path)
    sc._tidelog_shipped = True


def clear_shared(spark: SparkSession) -> None:
    """Remove every table that this application wrote to the shared folder; results that still read them are lost."""
    p = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._tidelog_shipped = False
