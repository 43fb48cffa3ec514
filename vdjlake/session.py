"""Session settings and the cutting of long lineages."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def session(app: str = "vdjlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE with skew handling).

    ``conf`` keys use ``__`` in place of dots, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and all executors are in this machine's one process
    (tests) a temporary folder is set for the session; a cluster without it is refused,
    since each executor would write to a disk of its own.
    """
    at = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_KEY} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vdjlake-")
        spark.conf.set(_KEY, at)
    return at.rstrip("/")


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage at a replicated, columnar copy: a lost executor costs only
    the tasks it ran, and nothing before the cut is computed again. The files go
    when the JVM ends, or earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vdjlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._vdjlake_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Remove the files behind tables made by :func:`table`; others are left alone."""
    for df in dfs:
        path = getattr(df, "_vdjlake_path", None)
        if path:
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once per session.

    Workers then need neither the working directory nor the search path of the
    driver.
    """
    sc = spark.sparkContext
    if getattr(sc, "_vdjlake_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="vdjlake-"), "vdjlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._vdjlake_shipped = True


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, from the cluster's default parallelism."""
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
