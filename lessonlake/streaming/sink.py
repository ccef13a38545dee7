"""A table of the latest row of each key, which the update batches of a stream go to.

A batch is a folder of its number; putting it again replaces it. Every few batches those before the one at hand are merged with the base into
a new base, so the number of folders is bounded. A base counts once it is complete; it holds only batches that the stream won't
repeat, so a batch that is repeated still finds the table as it was before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lessonlake.operators.activity import COUNTERS
from lessonlake.sources import store


class UpsertSink:
    """path: the table's folder; keys: its key columns; schema: its columns; every: batches that may wait for the next merge."""

    def __init__(self, path: str, keys: list[str], schema: str, every: int = 16):
        self.path, self.keys, self.schema, self.every = path, keys, schema, every

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in store.names(spark, self.path) if n.startswith(f"{kind}="))

    def _base(self, spark: SparkSession) -> int:
        """The number of the last complete base, or -1."""
        return max((n for n in self._numbers(spark, "base") if store.exists(spark, f"{self.path}/base={n}/_SUCCESS")), default=-1)

    def put(self, batch: DataFrame, number: int) -> None:
        """Writes a batch of the keys' new rows. For foreachBatch."""
        spark = batch.sparkSession
        if number - self._base(spark) > self.every:
            self.merge(spark, number - 1)
        batch.select(*StructType.fromDDL(self.schema).names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The latest row of each key, of the batches up to a number or of all."""
        base = self._base(spark)
        empty = spark.createDataFrame([], self.schema)
        whole = spark.read.schema(self.schema).parquet(f"{self.path}/base={base}") if base >= 0 and (upto is None or upto >= base) else empty
        later = [n for n in self._numbers(spark, "batch") if n > base and (upto is None or n <= upto)]
        if not later:
            return whole
        rows = [spark.read.schema(self.schema).parquet(f"{self.path}/batch={n}").withColumn("_batch", F.lit(n)) for n in later]
        new = rows[0]
        for r in rows[1:]:
            new = new.unionByName(r)
        latest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_batch")))
        new = new.withColumn("_rank", latest).where("_rank = 1").drop("_rank", "_batch")
        return whole.join(new.select(*self.keys), self.keys, "left_anti").select(*whole.columns).unionByName(new)

    def merge(self, spark: SparkSession, upto: int) -> None:
        """Merges the batches up to a number into a new base, then deletes what it replaces."""
        batches, bases = self._numbers(spark, "batch"), self._numbers(spark, "base")
        if upto <= self._base(spark) or not [n for n in batches if n <= upto]:
            return
        self.read(spark, upto).write.mode("overwrite").parquet(f"{self.path}/base={upto}")
        for kind, numbers in (("batch", batches), ("base", bases)):
            for n in numbers:
                if n <= upto and (kind, n) != ("base", upto):
                    store.delete(spark, f"{self.path}/{kind}={n}")


def daily_sink(path: str, every: int = 16) -> UpsertSink:
    return UpsertSink(path, ["student_key", "date_key"], "student_key string, date_key string, " + ", ".join(f"{c} long" for c in COUNTERS), every)


def wallet_sink(path: str, every: int = 16) -> UpsertSink:
    return UpsertSink(path, ["student_key"], "student_key string, credits long, points long, lifetime long, used long", every)
