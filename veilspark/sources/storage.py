"""Where intermediate tables of iterative and multi-pass operators are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local folders by application (tests), and what each application has written.
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder all executors share: below ``spark.checkpoint.dir``.

    Only where that is unset and everything runs in one process (tests), a temporary local
    folder takes its place until the process ends; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="veilspark-")
            atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
        base = "file://" + _LOCAL[application]
    return f"{base.rstrip('/')}/{name}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, f"{label}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what ``written`` has left in the shared folder; to be called when the results that were made from it are stored.

    DataFrames are lazy, so an operator can't know that itself. Gives the number of folders.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def texts_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name -> text of the files that ``publish`` put into a folder; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    out = {}
    for f in fs.listStatus(path):
        if not f.getPath().getName().startswith("."):
            stream = fs.open(f.getPath())
            out[f.getPath().getName()] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def publish(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Writes a small file that readers see whole or not at all; fails if there is one of that name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    draft, final = path(folder, f".{name}-{uuid.uuid4().hex}"), path(folder, name)
    stream = fs.create(draft)
    stream.write(text.encode())
    stream.close()
    renames = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(draft), fs.makeQualified(final), renames)
