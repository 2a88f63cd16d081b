"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child draws an exponential variate
-ln(u) / weight, u being a hash of the row's key and the child's name, and the least draw wins.  A child's draw depends
on nothing but the key, its name and its weight, so a changed weight moves rows only into or out of that child's
subtree.

The tree is laid out for `base` shards: shard s sits in rack s // 4 and region s // 12.  A shard that is added later
opens a region of its own, numbered after those, as long as the tree isn't laid out anew: no older weight changes, so
rows move only into it.  That holds for every count from `base` on; fewer shards than `base` are refused.

A null key is a key like any other; null text has no bytes; repeated rows go to the same shard and get slots of their
own; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import materialize, table

RACK_SHARDS, REGION_RACKS = 4, 3
#: Pieces into which a shard is dealt while its slots are numbered.
SLOT_BUCKETS = 512


def tree(shards: int, base: int, weights: dict[int, float] | None = None) -> tuple[list[float], list[float], list[float]]:
    """Weights of leaves, racks and regions by number; places that no shard takes have none."""
    if not 1 <= base <= shards:
        raise ValueError(f"{shards} shards in a tree laid out for {base}")
    span = RACK_SHARDS * REGION_RACKS
    laid = -(-base // span)
    leaf = [0.0] * ((laid + shards - base) * span)
    for s in range(shards):
        leaf[s if s < base else (laid + s - base) * span] = float((weights or {}).get(s, 1.0))
    rack = [sum(leaf[i : i + RACK_SHARDS]) for i in range(0, len(leaf), RACK_SHARDS)]
    region = [sum(rack[i : i + REGION_RACKS]) for i in range(0, len(rack), REGION_RACKS)]
    return leaf, rack, region


def descend(key: Column, level: str, parent: Column, fanout: int, weights: list[float]) -> Column:
    """The child of `parent`, numbered parent * fanout + i, whose draw is least."""

    def draw(i: Column) -> Column:
        node = parent * fanout + i
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        weight = F.element_at(F.lit(weights), node + 1)
        return F.when(weight > 0, F.struct((-F.log(u) / weight).alias("draw"), node.alias("node")))

    return F.array_min(F.transform(F.lit(list(range(fanout))), draw))["node"]


def with_shard(rows: DataFrame, key: str, name: str, shards: int, base: int, weights: dict[int, float] | None = None) -> DataFrame:
    leaf, rack, region = tree(shards, base, weights)
    for level, column, parent, fanout, w in (
        ("region", f"{name}_region", F.lit(0), len(region), region),
        ("rack", f"{name}_rack", F.col(f"{name}_region"), REGION_RACKS, rack),
        ("shard", name, F.col(f"{name}_rack"), RACK_SHARDS, leaf),
    ):
        rows = rows.withColumn(column, descend(F.col(key), level, parent, fanout, w))
    span, laid = RACK_SHARDS * REGION_RACKS, len(region) - (shards - base)
    grown = F.lit(base - laid) + F.floor(F.col(name) / span).cast("int")  # the leaf's region, as a shard's number
    rows = rows.withColumn(name, F.when(F.col(name) >= laid * span, grown).otherwise(F.col(name)))
    return rows.drop(f"{name}_region", f"{name}_rack")


def shard_rows(docs: DataFrame, shards: int, *, base: int | None = None, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard) and slot, gapless from 0 in each shard.
    base: how many shards the tree was laid out for, if not for all.

    Slots come from counts of (shard, bucket), a few thousand rows, and a numbering within each bucket, so no task has
    to order a shard.  A bucket depends on the text too: a hot id doesn't fill one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    base = shards if base is None else base
    rows = with_shard(with_shard(rows, "doc_id", "shard", shards, base, weights), "doc_id", "grown_shard", shards + 1, base, weights)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_BUCKETS)).cast("int"))
    # equal rows are counted, not listed, so even a third of all rows being the same row is one row here
    same = rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    same = materialize(same, "placed")  # numbered and counted from, so not to be made twice
    before = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("local", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = same.groupBy("shard", "bucket").agg(F.sum("n").alias("c"))  # shards * SLOT_BUCKETS rows at most
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    placed = same.join(starts, ["shard", "bucket"])
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    return placed.select("*", copies).withColumn("slot", F.col("start") + F.col("local") + F.col("copy"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op10_hash_tree": op10_hash_tree}
ORACLE_SQL: dict[str, str] = {}
