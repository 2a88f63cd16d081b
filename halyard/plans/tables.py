"""The test tables in the roles that the operators expect, and the same roles in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as items: every seventh has no album, and one album's name is blank."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("bucket_id"),
        F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.upper("event_type")).alias("bucket_name"),
        F.col("ts").cast("timestamp").alias("date_added"),
    )


CATALOG = """c as (select event_id as id, case when event_id % 7 <> 0 then event_type end as bucket_id,
  case when event_type = 'error' then ' ' else upper(event_type) end as bucket_name, ts as date_added from events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short query-like texts: names of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


def messy(c: str = "text") -> str:
    """SQL for a text with the troubles of typed queries, by id."""
    return f"case id % 5 when 0 then concat('  ', upper({c}), chr(9), ' ') when 1 then concat(chr(10), replace({c}, ' ', '   ')) when 2 then concat('a photo of ', {c}) when 3 then concat(' ', chr(9)) else {c} end"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder where the session's shared one is; a temporary one where all runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top or tempfile.gettempdir() + '/halyard-checkpoints'}/halyard-{name}-{uuid.uuid4().hex}"
