"""Tables with one row a key: batches are merged in, and only what they change is written anew.

Rows lie in folders by the key's hash. A batch reads the folders of its own keys and replaces those in which a row
changed, by Spark's dynamic partition overwrite; the others keep their files. A batch that is merged twice changes
nothing the second time, so a merge that failed is simply repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, written

BUCKETS = 64


@dataclass
class KeyedTable:
    """key: the columns that name a row; order: the column that says which of two rows of a key is the newer (none: the
    later batch); buckets: folders, fixed for the table's life. Stored rows have `version` besides, which counts how often
    their content has changed. A row with a null in its key is not taken."""

    spark: SparkSession
    path: str
    key: list[str]
    order: str | None = None
    buckets: int = BUCKETS

    def read(self) -> DataFrame | None:
        """The rows; none if nothing was merged yet."""
        rows = self._stored()
        return None if rows is None else rows.drop("_bucket")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as error:  # noqa: BLE001  nothing stored yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def latest(self, batch: DataFrame) -> DataFrame:
        """Of a key's rows in a batch the newest; of equally new ones that with the largest content hash. Rows are
        compared by task before they are shuffled, so a key that fills a batch is no large group."""
        content = [c for c in batch.columns if c not in self.key]
        rank = F.struct(*([F.col(self.order)] if self.order else []), F.xxhash64(*content))
        known = batch.where(" and ".join(f"`{c}` is not null" for c in self.key))
        newest = known.groupBy(*self.key).agg(F.max_by(F.struct(*content), rank).alias("_new"))
        return newest.select(*self.key, "_new.*", self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket")

    def beside(self, batch: DataFrame) -> DataFrame | None:
        """The stored rows of the folders that a batch's keys lie in; none if nothing was merged yet."""
        rows = self._stored()
        if rows is None:
            return None
        met = [r["_bucket"] for r in batch.select(self._bucket()).where("_bucket is not null").distinct().collect()]  # at most `buckets` numbers
        return rows.where(F.col("_bucket").isin(met)).drop("_bucket")

    def merge(self, batch: DataFrame) -> int:
        """Takes the batch's rows in; how many rows of the table changed. A row older than the stored one changes nothing."""
        content = [c for c in batch.columns if c not in self.key]
        values = [c for c in content if c != self.order]
        fresh, stored = self.latest(batch), self._stored()
        if stored is None:
            self._put(fresh.withColumn("version", F.lit(1).cast("long")), batch.columns)
            stored = self._stored()
            return 0 if stored is None else stored.count()
        fresh = written(fresh, "fresh")
        met = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        old = stored.where(F.col("_bucket").isin(met)).select(*self.key, *(F.col(c).alias(f"_old_{c}") for c in content), F.col("version").alias("_version"))
        joined = fresh.join(old, self.key, "left")
        differs = F.lit(False)
        for c in values:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        news = differs
        if self.order:
            # A newer row of equal content is kept too: what comes between the two later on is then known to be old.
            now, before = F.col(self.order), F.col(f"_old_{self.order}")
            news = (before.isNull() | (now >= before)) & (differs | ~now.eqNullSafe(before))
        taken = joined.where(F.col("_version").isNull() | news)
        version = F.coalesce("_version", F.lit(0).cast("long")) + F.when(F.col("_version").isNull() | differs, 1).otherwise(0)
        changed = written(taken.select(*batch.columns, version.alias("version"), "_bucket"), "changed")
        touched = [r["_bucket"] for r in changed.select("_bucket").distinct().collect()]
        if touched:
            kept = stored.where(F.col("_bucket").isin(touched)).join(changed.select(*self.key), self.key, "left_anti")
            self._put(kept.select(*batch.columns, "version", "_bucket").unionByName(changed), batch.columns)
        count = changed.count()
        discard(fresh, changed)
        return count

    def _put(self, rows: DataFrame, columns: list[str]) -> None:
        """Replaces the folders of these rows. A folder's rows are as many as its share of the keys."""
        out = rows.select(*columns, "version", "_bucket").repartition("_bucket").sortWithinPartitions("_bucket", *self.key)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
