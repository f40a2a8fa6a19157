"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


# A generated method above 8,000 bytes of code is never compiled by the JVM and runs
# interpreted; with this limit Spark falls back to smaller methods instead. The rule
# and text projections are wide enough for that to matter several-fold.
CODEGEN = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in CODEGEN.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "riskframe", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in {**CODEGEN, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    A machine-local folder is acceptable only when the whole cluster is this
    machine; anywhere else a missing setting is an error, since files written on
    one executor would be invisible to the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="riskframe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is stored inside go when it is stored, not when the driver collects garbage.

    Only for frames that are written once: one that is run again afterwards would look for them.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
