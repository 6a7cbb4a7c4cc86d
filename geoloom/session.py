"""Session helpers: shared scratch tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) is a folder of our own made and set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="geoloom-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/geoloom-{uuid.uuid4().hex}-{name}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _scratch.append((hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    The result has no lineage, so a lost executor costs a reread and not a
    recomputation, and its size is known to the optimizer. The folder is
    removed when the driver's Python ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes the folders of tables made by ``stored``, once nothing will read them again."""
    global _scratch
    paths = {getattr(t, "_scratch_path", None) for t in tables} - {None}
    kept = []
    for fs, path in _scratch:
        if any(path.toString().endswith(p.rsplit("/", 1)[-1]) for p in paths):
            fs.delete(path, True)
        else:
            kept.append((fs, path))
    _scratch = kept


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold ``rows`` rows at most, unless the session asks for fewer.

    For operators that send whole texts to Python workers: a batch is held by
    the JVM and by the worker, for each task that an executor runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = int(spark.conf.get(key, "10000"))
    if known <= 0 or known > rows:
        spark.conf.set(key, str(rows))


@atexit.register
def _clear() -> None:
    for fs, path in _scratch:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM has ended before us
            return


def local_session(cpus: int | str = "*", app: str = "geoloom", **conf: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a cluster, or of a local master whose workers' path does not lead to it.

    Only a local master's workers start in the driver's folder with its PYTHONPATH.
    """
    import os
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    at_hand = context.master.startswith("local") and not context.master.startswith("local-cluster") and any(p and Path(p).resolve() == root for p in known)
    if at_hand or getattr(context, "_geoloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="geoloom-")) / "geoloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.glob("geoloom/**/*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))
    context._geoloom_shipped = True
