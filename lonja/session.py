"""Session helpers: the local test session, and the shared folder where lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Contexts that have the package, and folders written for each; both by application id.
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, list[str]] = {}


def local_session(cores: int = 8, partitions: int = 8, app: str = "lonja") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="lonja_wh_"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where it is unset a local session (tests) gets a temporary
    one; on a cluster that is an error, for a machine's own folder would lose the rows of the others."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lonja_ckpt_")
    spark.sparkContext.setCheckpointDir(made)
    return made


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="lonja_py_"), "lonja.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def fresh_path(spark: SparkSession, what: str) -> str:
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(release, spark)
    _WRITTEN[app].append(path := f"{shared_dir(spark)}/lonja_{what}_{uuid.uuid4().hex[:12]}")
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this session has written to the shared folder, once its results are no longer needed; also at the end of
    the program where the session still runs. Returns the number of folders."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId if spark.sparkContext._jsc else "", [])
    n = len(paths)
    while paths:
        with contextlib.suppress(Exception):  # the session may be gone
            delete_path(spark, paths[-1])
        paths.pop()
    return n


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The frame in as many partitions as the session has cores, if its input comes in fewer splits: for expressions that cost
    more than a shuffle of the columns they read. A large input has splits enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
