"""The index on disk: versions that are never changed, and a pointer to the current one; the older single-file format.

A store is a folder of versions.  A version is written whole under a new name and counts once its marker table names it,
so a reader sees the old one or the new one.  Appended checkpoints are versions' parts that compaction folds.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.config import MAX_URI, MAX_VECTOR
from halyard.operators.index import accepted, upsert

SCHEMA = T.StructType([T.StructField("uri", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("version", T.LongType())])
MARKER = T.StructType([T.StructField("name", T.StringType()), T.StructField("seq", T.LongType())])


def absent(error: AnalysisException) -> bool:
    """Whether a table isn't there yet; anything else that is wrong with it is no empty table."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _markers(self) -> DataFrame:
        try:
            return self.spark.read.schema(MARKER).parquet(f"{self.path}/current")
        except AnalysisException as e:
            if not absent(e):
                raise
            return self.spark.createDataFrame([], MARKER)

    def current(self) -> tuple[str, int] | None:
        row = self._markers().agg(F.max_by("name", "seq").alias("name"), F.max("seq").alias("seq")).first()
        return (row["name"], row["seq"]) if row["name"] else None

    def load(self) -> DataFrame:
        """Valid rows of the current version; none if there is no store."""
        now = self.current()
        if not now:
            return self.spark.createDataFrame([], SCHEMA)
        return accepted(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{now[0]}"))

    def save(self, index: DataFrame) -> None:
        """A new version, then the pointer to it."""
        name, now = f"v-{uuid.uuid4().hex}", self.current()
        accepted(index.select(*SCHEMA.names)).write.parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(name, now[1] + 1 if now else 0)], MARKER).coalesce(1).write.mode("append").parquet(f"{self.path}/current")

    def checkpoint(self, rows: DataFrame) -> None:
        """Rows appended beside the current version, for merge() to take in."""
        accepted(rows.select(*SCHEMA.names)).write.mode("append").parquet(f"{self.path}/pending")

    def pending(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/pending")
        except AnalysisException as e:
            if not absent(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def snapshot(self) -> DataFrame:
        """The current version with all checkpoints."""
        return upsert(self.load(), self.pending())

    def replace(self, rows: DataFrame) -> None:
        """A version of just these rows; what checkpoints have appended up to now counts no longer."""
        self.save(rows)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pending")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def compact(self) -> None:
        """A version that holds what checkpoints appended; reading them again later changes nothing."""
        self.save(self.snapshot())


# The single-file format begins with this word and version; numbers are big-endian.
MAGIC, VERSION = 0x47534958, 2


def parse_file(content: bytes) -> list[tuple[str, list[float]]] | None:
    """Records of one file, or None if anything in it is wrong."""
    try:
        magic, version, count = struct.unpack_from(">iii", content, 0)
        if (magic, version) != (MAGIC, VERSION) or count < 0:
            return None
        at, out = 12, []
        for _ in range(count):
            (n,) = struct.unpack_from(">i", content, at)
            if not 1 <= n <= MAX_URI or at + 4 + n > len(content):
                return None
            uri = content[at + 4 : at + 4 + n].decode()
            at += 4 + n
            (n,) = struct.unpack_from(">i", content, at)
            if not 1 <= n <= MAX_VECTOR or at + 4 + 4 * n > len(content):
                return None
            out.append((uri, np.frombuffer(content, ">f4", n, at + 4).astype("<f4").tolist()))
            at += 4 + 4 * n
    except (struct.error, UnicodeDecodeError):
        return None
    return out


def format_file(rows: list[tuple[str, list[float]]]) -> bytes:
    parts = [struct.pack(">iii", MAGIC, VERSION, len(rows))]
    for uri, vector in rows:
        raw = uri.encode()
        parts.append(struct.pack(">i", len(raw)) + raw + struct.pack(">i", len(vector)) + np.asarray(vector, ">f4").tobytes())
    return b"".join(parts)


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file, through the file system that Spark has for the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(content)
    out.close()


def write_files(rows: DataFrame, folder: str) -> None:
    """Single-file indexes of rows(file, uri, embedding), one for each `file`.  A file is one record here and passes the
    driver, one after the other: the format is for a device's index, and large ones belong in an IndexStore."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uri")
        return pd.DataFrame([(str(key[0]), format_file(list(zip(frame["uri"], frame["embedding"], strict=True))))], columns=["file", "content"])

    packed = rows.groupBy("file").applyInPandas(pack, "file string, content binary")
    for r in packed.toLocalIterator():
        put_bytes(rows.sparkSession, f"{folder}/{r['file']}.bin", bytes(r["content"]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri, embedding) of single-file indexes; a damaged file gives one row with a null uri, so it can be seen
    and re-indexed.  Nothing is deleted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"], strict=True) for r in (lambda x: [(None, None)] if x is None else x)(parse_file(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "uri", "embedding"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, uri string, embedding array<float>")
