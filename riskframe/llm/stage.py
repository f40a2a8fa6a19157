"""Tables written once in the cluster's shared folder and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.session import shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; removed when the driver ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(java, True)
        except Exception:  # the session may be gone already; nothing depends on this
            pass

    atexit.register(remove)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and return a frame that reads it.

    Lost executors cannot take it away, and whatever reads it twice computes it once.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of the frame has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, uid) of documents: uid tells apart rows that share a doc_id.

    Columns of the same name in another case or of other use are left behind here.
    Rows alike in both columns have one uid; operators give them one result each.
    """
    return docs.select(F.col("doc_id"), F.col("text"),
                       F.xxhash64(F.col("doc_id"), F.col("text")).alias("uid"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Spark's file server hands the archive to every executor, also to those that join
    later, so tasks can import the package wherever the driver found it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil
    import tempfile
    from pathlib import Path

    import riskframe
    root = Path(riskframe.__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='riskframe-code-')}/riskframe", "zip",
                                  root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def returned() -> None:
    """Give memory that a worker no longer uses back to the machine; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa
    from riskframe.llm import text
    text.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc alone has it
    if trim is not None:
        trim(0)


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand in the workers, which keep little afterwards."""
    ship(df.sparkSession)

    def task(batches):
        yield from function(batches)
        returned()

    return df.mapInArrow(task, schema)
