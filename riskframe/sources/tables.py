"""Reading and writing the credit tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.sources import refdata, schemas


class Tables(Mapping[str, DataFrame]):
    """The credit model by name: stored tables plus the small code tables.

    ``later`` names tables that are built when they are first asked for, each by a function
    that gives one or several of them.
    """

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame],
                 later: Mapping[str, Callable[[], Mapping[str, DataFrame]]] | None = None):
        self.spark = spark
        self._frames = dict(frames)
        self._later = dict(later or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames and name in self._later:
            self._frames.update({n: f for n, f in self._later[name]().items() if n not in self._frames})
        if name not in self._frames and name in refdata.code_table_names():
            self._frames[name] = refdata.code_table(self.spark, name)
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter({**self._frames, **self._later})

    def __len__(self) -> int:
        return len({**self._frames, **self._later})

    def replace(self, **frames: DataFrame) -> "Tables":
        return Tables(self.spark, {**self._frames, **frames}, self._later)


def keyed_join(rows: DataFrame, block: DataFrame, on: str = "application_id",
               how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the applications or customers: merged by key.

    Pruned to a few narrow columns, a table of millions of rows looks small enough to be
    broadcast, and several of those fill the driver. Bucketed sides merge without an exchange.
    """
    return rows.join(block.hint("merge"), on, how)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared columns and types, in the declared order."""
    fields = [part.split() for part in schemas.TABLES[table].split(", ")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in fields])


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{folder}/{table}")


def read_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(spark, {name: read_table(spark, folder, name) for name in schemas.TABLES})


def write_table(df: DataFrame, folder: str, table: str, *, mode: str = "overwrite",
                buckets: int = 0, catalog_prefix: str = "") -> DataFrame:
    """Write one table and return it as read back.

    With ``buckets`` the one-row-per-application tables are stored bucketed by
    their application key: joining them later needs no exchange at all.
    ``mode="ignore"`` reuses what an earlier load left in the folder.
    """
    spark = df.sparkSession
    path = f"{folder}/{table}"
    key = schemas.BUCKET_KEY.get(table)
    shaped = conform(df, table)
    if not buckets or key is None:
        shaped.write.mode(mode).parquet(path)
        return read_table(spark, folder, table)
    return write_bucketed(shaped, path, f"{catalog_prefix}{table}", key, buckets, mode=mode)


def write_bucketed(df: DataFrame, path: str, name: str, key: str, buckets: int, *,
                   mode: str = "overwrite") -> DataFrame:
    """Write rows bucketed and sorted by a key; rows that lie so already are not exchanged."""
    (df.repartition(buckets, key)
     .write.mode(mode).bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def write_many(spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]],
               folder: str, **options) -> dict[str, DataFrame]:
    """Build and write independent tables side by side; each is its own Spark job."""
    def one(item: tuple[str, DataFrame | Callable[[], DataFrame]]) -> tuple[str, DataFrame]:
        name, frame = item
        built = frame if isinstance(frame, DataFrame) else frame()
        return name, write_table(built, folder, name, **options)

    with ThreadPoolExecutor(max_workers=max(1, len(frames))) as pool:
        return dict(pool.map(one, frames.items()))


def rebuild(spark: SparkSession, folder: str, source: Callable[[str], DataFrame], *,
            overwrite: bool = False, buckets: int = 0) -> Tables:
    """Recreate every table from ``source``, or reuse the folder as it is."""
    mode = "overwrite" if overwrite else "ignore"
    return Tables(spark, {name: write_table(source(name), folder, name, mode=mode,
                                            buckets=buckets)
                          for name in schemas.TABLES})
