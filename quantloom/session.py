"""Session helpers: shipping this package to executors and materialising intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def make_session(app: str = "quantloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine expects; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions import there."""
    sc = spark.sparkContext
    if getattr(sc, "_quantloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quantloom-"), "quantloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("quantloom", os.path.relpath(path, root)))
    sc.addPyFile(out)
    atexit.register(shutil.rmtree, os.path.dirname(out), True)
    sc._quantloom_shipped = True


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; on a local master without one, as in tests, a temporary folder.

    On a cluster each executor would write to its own disk, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(sc, "_quantloom_scratch", None):
        sc._quantloom_scratch = tempfile.mkdtemp(prefix="quantloom-ckpt-")
        sc.setCheckpointDir(sc._quantloom_scratch)
        atexit.register(shutil.rmtree, sc._quantloom_scratch, True)
    return f"file://{sc._quantloom_scratch}"


#: In force while a table is saved: shuffle files go when the write has ended, and batches to Python stay small.
WHILE_SAVED = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_saving: dict[int, tuple[int, dict]] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def settings_while_saved(spark: SparkSession):
    """WHILE_SAVED holds until the last of the threads that save in this session is done, and then what was set before."""
    key = id(spark)
    with _lock:
        users, before = _saving.get(key, (0, {}))
        if not users:
            before = {k: spark.conf.get(k) for k in WHILE_SAVED}
            for k, v in WHILE_SAVED.items():
                spark.conf.set(k, v)
        _saving[key] = users + 1, before
    try:
        yield
    finally:
        with _lock:
            users, before = _saving.pop(key)
            if users > 1:
                _saving[key] = users - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with settings_while_saved(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what saved() wrote; df must not be read afterwards."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
