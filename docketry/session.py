"""Session helpers: a local builder for tests, and lineage cutting that survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "docketry") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local session gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif (sc.master or "").startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session: their Python workers need not have it installed.

    Reading a table by name does so; with frames of another origin call it before the first operator.
    """
    sc = spark.sparkContext
    if getattr(sc, "_docketry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="docketry-package-")) / "docketry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._docketry_shipped = True


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it from there.

    Later stages never recompute it, and a lost executor loses none of it. Unlike ``checkpoint()`` the
    table's size is that of its files; sizes estimated again in every round of a loop grow without bound,
    which costs minutes of planning and hides small tables from the optimizer.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docketry_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames from ``cut`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_docketry_path", None)
        if path in _written:
            _delete(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


@atexit.register
def _delete_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the gateway may be gone already
            return
