"""A stored table with one row per key, in buckets by key, whose merges rewrite only the buckets they touch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.measures import is_live
from ..session import settings
from .maintain import KEY, arrived_between, increment, latest_rows

BUCKETS = 64


class KeyedTable:
    """Each bucket is a partition folder and holds the keys with one hash, so it can be replaced alone.

    The table is bucketed by key as well: a scan deals it by key as joins want it, so merges shuffle the changes only.
    ``name`` is a table of the session's catalog that points at ``path``; another session opens it by the same call.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: str, key: str = KEY, buckets: int = BUCKETS):
        self.spark, self.name, self.path, self.key, self.buckets = spark, name, path, key, buckets
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(""))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}, bucket INT) USING parquet PARTITIONED BY (bucket) "
            f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        self.columns = [c for c in spark.table(name).columns if c != "bucket"]

    def _path(self, child: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{child}")

    @property
    def _bucket(self) -> Column:
        """The bucket that Spark's own bucketing puts a key into; the null key is in one of them."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def _replace(self, rows: DataFrame) -> None:
        """Overwrite the buckets that occur in the rows, which are dealt by key already."""
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            rows.select(*self.columns, "bucket").write.mode("overwrite").insertInto(self.name)

    def _drop(self, buckets: set[int]) -> None:
        for bucket in buckets:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (bucket = {bucket})")
            self._files.delete(self._path(f"bucket={bucket}"), True)

    def fill(self, rows: DataFrame) -> None:
        """Write the table anew; rows have one row for each key."""
        self._replace(rows.withColumn("bucket", self._bucket).repartition(self.buckets, self.key))
        self._drop(set(range(self.buckets)) - set(self.touched(rows)))

    def touched(self, changes: DataFrame) -> list[int]:
        """Buckets that hold a key of the changes: ``buckets`` numbers at most."""
        return sorted(r[0] for r in changes.select(self._bucket).distinct().collect())

    def merged(self, changes: DataFrame, touched: list[int]) -> DataFrame:
        """The touched buckets after the changes: a full join on the key, in which the table stays where it is."""
        key = F.col(self.key)
        table = self.spark.table(self.name).filter(F.col("bucket").isin(touched)).drop("bucket")
        old = table.filter(key.isNotNull()).select(F.struct(*self.columns).alias("_old"), key.alias("_old_key"))
        new = changes.filter(key.isNotNull()).select(
            F.struct(*self.columns).alias("_new"), key.alias("_new_key"), is_live().alias("_live")
        )
        both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full").filter("_new IS NULL OR _live")
        row = F.coalesce("_new", "_old")
        rows = both.select(*[row[c].alias(c) for c in self.columns])
        # A null key equals no other in a join: the change of it, or else its old row, stands apart.
        nameless = changes.filter(key.isNull()).select(*self.columns)
        kept = table.filter(key.isNull()).join(nameless.select(F.lit(1)), F.lit(True), "left_anti")
        rows = rows.unionByName(nameless.filter(is_live())).unionByName(kept)
        return rows.withColumn("bucket", self._bucket)

    def upsert(self, changes: DataFrame) -> list[int]:
        """Replace each key by its change (one row for each key); a tombstone removes the key.  Returns what is rewritten.

        A bucket in which no row is left is dropped, since only buckets with rows are overwritten.
        """
        touched = self.touched(changes)
        if touched:
            rows = self.merged(changes, touched)
            left = {r[0] for r in rows.select("bucket").distinct().collect()}
            self._replace(rows)
            self._drop(set(touched) - left)
        return touched

    def merge(self, log: DataFrame, last: datetime | str | None, cutoff: datetime | str) -> list[int]:
        """Bring the state from ``last`` to ``cutoff``."""
        return self.upsert(latest_rows(increment(log, last, cutoff), key=self.key))

    def backfill(self, log: DataFrame, start: datetime | str, end: datetime | str) -> list[int]:
        """Recompute the keys that changed in the closed arrival range [start, end] from that range alone."""
        return self.upsert(latest_rows(arrived_between(log, start, end), key=self.key))
