"""Key-value state of a library: selected albums, time of the last index run, tuned threads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.sources.index_store import absent

SCHEMA = T.StructType([
    T.StructField("at", T.TimestampType()),
    T.StructField("selected_albums", T.ArrayType(T.StringType())),
    T.StructField("last_indexed_ms", T.LongType()),
    T.StructField("threads", T.IntegerType()),
])


def with_defaults(rows: DataFrame) -> DataFrame:
    """One row: the last non-null value of each key, or its default."""
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))) for c in SCHEMA.names[1:]}
    return rows.agg(
        F.coalesce(last["selected_albums"], F.array().cast("array<string>")).alias("selected_albums"),
        F.coalesce(last["last_indexed_ms"], F.lit(0)).cast("long").alias("last_indexed_ms"),
        F.coalesce(last["threads"], F.lit(0)).cast("int").alias("threads"),
    )


class State:
    """Appends; the last write of a key counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if not absent(e):
                raise
            rows = self.spark.createDataFrame([], SCHEMA)
        return with_defaults(rows)

    def write(self, *, selected_albums: list[str] | None = None, last_indexed_ms: int | None = None, threads: int | None = None) -> None:
        row = self.spark.createDataFrame([(None, selected_albums, last_indexed_ms, threads)], SCHEMA).withColumn("at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(self.path)
