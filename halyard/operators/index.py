"""Index maintenance as joins and change sets on (uri, embedding, version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.config import MAX_URI, MAX_VECTOR
from halyard.functions.vectors import is_valid, l2_normalize


def in_bounds(uri: str = "uri", vector: str = "embedding") -> Column:
    """A uri of 1 to MAX_URI bytes and a vector of 1 to MAX_VECTOR elements; null is out of bounds."""
    return F.coalesce(F.octet_length(uri).between(1, MAX_URI) & F.size(vector).between(1, MAX_VECTOR), F.lit(False))


def accepted(rows: DataFrame, uri: str = "uri", vector: str = "embedding") -> DataFrame:
    """What may be read from or written to an index: in bounds and a usable vector."""
    return rows.filter(in_bounds(uri, vector) & is_valid(vector))


def quarantine(rows: DataFrame, uri: str = "uri", vector: str = "embedding") -> DataFrame:
    """The other rows, with why."""
    reason = F.when(~in_bounds(uri, vector), "bounds").when(~is_valid(vector), "vector")
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def cached(index: DataFrame, visible: DataFrame, key: str = "uri") -> DataFrame:
    """Index rows of visible items."""
    return index.join(visible.select(key), key, "left_semi")


def unindexed(catalog: DataFrame, index: DataFrame, key: str = "uri") -> DataFrame:
    """Catalog rows without a vector."""
    return catalog.join(index.select(key), key, "left_anti")


def upsert(index: DataFrame, fresh: DataFrame, key: str = "uri", version: str = "version") -> DataFrame:
    """One row per key, that of the highest version; fresh rows beat old ones of the same version.

    An aggregate, so copies of a hot key fold before the shuffle.
    """
    columns = index.columns
    rows = index.withColumn("_new", F.lit(0)).unionByName(fresh.select(*columns).withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct(*columns), F.struct(version, "_new"))
    return rows.groupBy(key).agg(last.alias("_row")).select("_row.*")


def build(index: DataFrame, fresh: DataFrame, key: str = "uri", version: str = "version", vector: str = "embedding") -> DataFrame:
    """The index with newly encoded rows: normalised, checked, upserted.  Rows of other items stay."""
    usable = fresh.filter(is_valid(vector)).withColumn(vector, l2_normalize(vector).cast(index.schema[vector].dataType))
    return upsert(index, usable, key, version)


def gone(index: DataFrame, alive: DataFrame, key: str = "uri") -> DataFrame:
    """Index rows whose item no longer exists."""
    return index.join(alive.select(key), key, "left_anti")


def edited(index: DataFrame, catalog: DataFrame, key: str = "uri", stamp: str = "modified") -> DataFrame:
    """Items whose stamp differs from the indexed one."""
    now = catalog.select(key, F.col(stamp).alias("_now"))
    return index.join(now, key).filter(~F.col(stamp).eqNullSafe(F.col("_now"))).select(key, F.col(stamp).alias("indexed"), F.col("_now").alias("current"))


def with_default(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """A lookup whose missing keys give `default`."""
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))
