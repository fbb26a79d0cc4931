"""Session helpers: building a local session for tests / bench and resolving
the shared checkpoint folder from the session configuration."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "docvec", extra: dict | None = None) -> SparkSession:
    """A session configured the way the library expects (AQE on, Arrow on,
    UI off).  On a cluster, pass the cluster master and leave
    ``spark.checkpoint.dir`` to the cluster configuration."""
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # lineage cuts are transient: delete their files once unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.cleaner.periodicGC.interval", "2min")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.maxResultSize", "4g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docvec`` importable in the Python workers (pandas UDF closures
    refer to its functions): zip the package once per application and add
    it with ``addPyFile`` (Spark distributes it to every executor)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="docvec-code-"), "docvec.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS / object store) folder and
    is used as is.  Only a local master, whose executors share the driver's
    disk, gets a scratch folder of its own when it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="docvec-ckpt-", dir=os.environ.get("DOCVEC_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    ship_package(spark)
    return d


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, by the file system of its own scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives the loss
    of executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_FREEING, _FREEING_LOCK = [0], threading.Lock()
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _freed_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside are deleted when it ends, not when the
    driver next collects garbage: a loop then holds one round's files.  Runs of
    several threads may overlap."""
    with _FREEING_LOCK:
        _FREEING[0] += 1
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        with _FREEING_LOCK:
            _FREEING[0] -= 1
            if not _FREEING[0]:
                spark.conf.unset(FREE_SHUFFLES)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder.  In loops this is
    the cut to take: a checkpoint keeps the size that the optimiser guessed for
    its plan, and guesses of joins multiply from round to round."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    with _freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None) if df is not None else None
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        if path_exists(spark, f"{sf_dir.rstrip('/')}/{n}.parquet"):
            load(spark, sf_dir, n).createOrReplaceTempView(n)
