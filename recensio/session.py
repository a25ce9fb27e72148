"""SparkSession settings for the review jobs.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; the helpers here only fill in what is unset, so the
same code runs in tests on ``local[*]``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE re-plans joins/partition counts from
# runtime sizes and splits skewed shuffle partitions.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "recensio") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  A scratch folder is created
    only for a local session that names none (tests, the benchmark); a
    cluster session must name a shared one."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        # As the session names it; whether all executors reach it is the
        # launcher's part.
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        # A folder on one machine is useless to executors elsewhere.
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="recensio-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``recensio`` importable in the Python workers of a local session.

    Operators that run Python on executors (the HTML walk, the strict JSON
    check) call this first.  On a cluster the launcher ships the package
    (``--py-files``); here, once per SparkContext, the package is zipped on
    the driver and added with ``addPyFile``, so workers import it whatever
    their working directory.
    """
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="recensio-pkg-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, "recensio.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, files in os.walk(root):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.join("recensio", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def materialize(df):
    """Write ``df`` to the session's checkpoint folder and read it back:
    later actions and joins start from the written rows instead of
    recomputing the lineage (used for small intermediate tables that
    decide a plan and are then joined)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """The same for a wide table that is read several times: written as
    compressed Parquet in the session's shared folder, a fraction of a
    checkpoint's room, of which a reader takes only the columns it needs."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
