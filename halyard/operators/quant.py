"""Model graphs as tables, and int8 weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.vectors import cosine

#: Node types whose weights are quantised.
TARGET_OPS = ("Conv", "MatMul", "Gemm")


def op_histogram(nodes: DataFrame, op: str = "op_type") -> DataFrame:
    return nodes.groupBy(op).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), op)


def op_report(nodes: DataFrame, ops: list[str], op: str = "op_type") -> DataFrame:
    """One row with a count for each of the named types."""
    return nodes.agg(*[F.count_if(F.col(op) == o).alias(f"n_{o}") for o in ops])


def targets(nodes: DataFrame, weights: DataFrame, *, sensitive: str | None = None) -> DataFrame:
    """Nodes of a target type with an initializer among their inputs; those whose name or type matches `sensitive`
    are left out."""
    used = nodes.filter(F.col("op_type").isin(*TARGET_OPS)).select("node", "op_type", F.explode("inputs").alias("weight"))
    out = used.join(weights.select(F.col("name").alias("weight")).distinct(), "weight", "left_semi")
    return out.filter(~(F.lower("node").rlike(sensitive) | F.lower("op_type").rlike(sensitive))) if sensitive else out


def channel_scales(weights: DataFrame) -> DataFrame:
    """(name, channel, scale) of weights(name, channel, value): a channel's largest magnitude is 127, a zero one has 1."""
    top = weights.groupBy("name", "channel").agg(F.max(F.abs("value")).alias("top"))
    return top.select("name", "channel", F.when(F.col("top") == 0, 1.0).otherwise(F.col("top") / 127).alias("scale"))


def agreement(a: DataFrame, b: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Average, least and largest cosine of two models' outputs for the same input."""
    pairs = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    c = cosine("_a", "_b")
    return pairs.select(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("avg_cos"), F.min("c").alias("min_cos"), F.max("c").alias("max_cos"))
