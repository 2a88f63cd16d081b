"""File sources: listings, whole files, JSON settings, tokenizer files, model graphs, synthetic inputs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_NAME = r"\.(jpg|jpeg|png|webp)$"


def is_image(path: Column | str) -> Column:
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(IMAGE_NAME)


def find_images(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """path, length and modification time of image files below a folder, the first `limit` by path; contents stay
    unread until a later column asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(is_image("path"))
    files = files.select("path", "length", "modificationTime")
    return files.orderBy("path").limit(limit) if limit else files


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path and content of files; Spark leaves out empty ones."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def do_normalize(json: Column | str) -> Column:
    """The setting of a processor file; missing or unreadable means true."""
    flag = F.get_json_object(F.col(json) if isinstance(json, str) else json, "$.do_normalize")
    return F.coalesce(F.when(F.lower(flag).isin("true", "false"), F.lower(flag) == "true"), F.lit(True))


TOKENIZER = T.StructType([T.StructField("model", T.StructType([T.StructField("vocab", T.MapType(T.StringType(), T.IntegerType())), T.StructField("merges", T.ArrayType(T.StringType()))]))])


def vocabulary(files: DataFrame, json: str = "value") -> DataFrame:
    """(token, id) of a tokenizer file."""
    return files.select(F.explode(F.from_json(json, TOKENIZER)["model"]["vocab"]).alias("token", "id"))


def merge_ranks(files: DataFrame, json: str = "value") -> DataFrame:
    """(left, right, rank): lines that aren't two parts are no merge, but count."""
    lines = files.select(F.posexplode(F.from_json(json, TOKENIZER)["model"]["merges"]).alias("rank", "line"))
    return lines.select(F.split("line", " ").alias("parts"), "rank").filter(F.size("parts") == 2).select(F.col("parts")[0].alias("left"), F.col("parts")[1].alias("right"), "rank")


GRAPH = T.ArrayType(T.StructType([T.StructField("node", T.StringType()), T.StructField("op_type", T.StringType()), T.StructField("inputs", T.ArrayType(T.StringType()))]))


def model_graph(files: DataFrame, json: str = "value") -> DataFrame:
    """(node, op_type, inputs) of a graph that was exported as a JSON list."""
    return files.select(F.explode(F.from_json(json, GRAPH)).alias("n")).select("n.*")


def noise(spark: SparkSession, rows: int, size: int, *, seed: int = 0, normal: bool = False) -> DataFrame:
    """Random vectors, the same for the same seed and cluster-independent: each element is drawn by its own number."""
    u = lambda i, salt: (F.shiftrightunsigned(F.xxhash64(F.col("id"), i, F.lit(seed), F.lit(salt)), 11).cast("double") + 0.5) / float(1 << 53)
    draw = (lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * 3.141592653589793 * u(i, 1))) if normal else (lambda i: u(i, 0))
    return spark.range(rows).select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), draw).cast("array<float>").alias("pixels"))


def solid(spark: SparkSession, value: list[float], pixels: int) -> DataFrame:
    """One channel-first image of a single colour."""
    return spark.range(1).select("id", F.flatten(F.array(*[F.array_repeat(F.lit(float(v)), pixels) for v in value])).cast("array<float>").alias("pixels"))


def not_null(rows: DataFrame, column: str) -> DataFrame:
    """What a calibration run reads: rows whose input could be made."""
    return rows.filter(F.col(column).isNotNull())


def write_report(report: DataFrame, path: str) -> None:
    """The nested score report as JSON lines; NaN scores stay readable."""
    report.select(F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
