"""A table laid out for pages: sorted rows in zones, and how many rows precede each zone."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulon.functions.expressions import quoted

ROWS_PER_ZONE = 100_000
#: An id holds the zone above this bit and the row in the zone below it.
ROW_BITS = 33


@dataclass
class PageIndex:
    """Pages of a written table by their place, without counting or sorting it again.

    Rows are in key order, ties in the order of the other columns; a zone is one folder, and its
    files hold the rows by ``__id``, so that a page reads only the row groups it lies in.
    """

    spark: SparkSession
    path: str
    key: str

    @classmethod
    def build(cls, df: DataFrame, key: str, path: str, rows_per_zone: int = ROWS_PER_ZONE) -> PageIndex:
        """Sort the rows by range and write them with their zone table: zone, low and high key,
        rows, and the rows before."""
        spark = df.sparkSession
        ties = [quoted(c).asc() for c, kind in df.dtypes if c != key and not kind.startswith("map")]
        zones = max(1, -(-df.count() // rows_per_zone))
        order = [quoted(key).asc(), *ties]
        # equal keys may lie in two zones, so all columns bound them
        ranged = df.repartitionByRange(zones, *order).sortWithinPartitions(*order)
        rows = ranged.withColumn("__id", F.monotonically_increasing_id()).withColumn("__zone", F.shiftright("__id", ROW_BITS))
        rows.write.mode("overwrite").partitionBy("__zone").parquet(f"{path}/rows")
        # without rows there is no file to tell the columns
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        written = cls(spark, path, key).rows()
        table = written.groupBy("__zone").agg(
            F.min(quoted(key)).alias("low"), F.max(quoted(key)).alias("high"),
            F.count_if(quoted(key).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"))
        before = Window.orderBy("__zone").rowsBetween(Window.unboundedPreceding, -1)
        table = table.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
        return cls(spark, path, key)

    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/zones")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/rows")

    def total(self) -> int:
        return self.zones().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def page(self, limit: int = 1000, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``. Only the zones of the page, each with at least
        one of its rows, reach the driver."""
        end = offset + limit
        near = self.zones().where((F.col("before") < end) & (F.col("before") + F.col("rows") > offset)).collect()
        rows = self.rows()
        if not near:
            return rows.limit(0).drop("__id", "__zone")

        def part(zone):
            start = zone["__zone"] << ROW_BITS
            first, last = max(0, offset - zone["before"]), min(zone["rows"], end - zone["before"])
            return (F.col("__zone") == zone["__zone"]) & F.col("__id").between(start + first, start + last - 1)

        return rows.where(reduce(lambda a, b: a | b, map(part, near))).orderBy("__id").drop("__id", "__zone")

    def rows_before(self, value) -> int:
        """How many rows have a smaller key (or none); only the zones that hold the key are read."""
        zones = self.zones()
        # nulls come first; a zone whose greatest key is smaller is counted, not read
        below = zones.where(F.col("high").isNull() | (F.col("high") < F.lit(value)))
        whole = below.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        partly = [r["__zone"] for r in zones.where((F.col("high") >= F.lit(value)) & ((F.col("low") < F.lit(value)) | (F.col("nulls") > 0))).collect()]
        if not partly:
            return whole
        own = quoted(self.key)
        return whole + self.rows().where(F.col("__zone").isin(partly) & (own.isNull() | (own < F.lit(value)))).count()
