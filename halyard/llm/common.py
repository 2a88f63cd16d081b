"""What the operators share: reading tables, text blocks for numpy kernels, word hashing, materialised tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.ship import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Text bytes that a kernel handles at once; a longer single document is a block of its own.
BLOCK_BYTES = 2 << 20

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a temporary folder serves a
    session that runs in one process; on a cluster every executor would write to a disk of its own, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "halyard-checkpoints")


def prepare(spark: SparkSession) -> None:
    """For the entry points, the registered queries and the pipeline's stages, not for operators: this package goes to the
    Python workers, and the session sends them rows a few MB at a time from here on; at the default, both sides hold ten
    times as much."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 2 * BLOCK_BYTES)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores behind it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so that lost executors or later branches don't repeat its work."""
    path = f"{shared_dir(df.sparkSession)}/halyard-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that this process has written to the shared folder.
WRITTEN: list[str] = []


def clean_up(spark: SparkSession, keep: int = 0, but: tuple[str, ...] = ()) -> None:
    """Deletes the tables that materialize() has written, without the first `keep` and those in `but`.  For the end of a
    job, as results that aren't stored need them, or for what lies behind a table that has been written since."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in WRITTEN[keep:] if p not in but]
    for p in gone:
        WRITTEN.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets into them of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text (one row at least), their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, ends = string_parts(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The little-endian 8 bytes that start at each byte, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))


MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def slice_hashes(view: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices, equal for equal bytes.  view: lanes() of the bytes."""
    h = lengths.astype(np.uint64) * M1
    pick = np.flatnonzero(lengths > 0)
    done = 0
    while len(pick):
        s, left = starts[pick] + done, lengths[pick] - done
        lane = view[s] & MASKS[np.minimum(left, 8)]
        h[pick] = mix(h[pick] ^ (lane + M1) * M2)
        done += 8
        pick = pick[left > 8]
    return h


#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[0x41:0x5B] += 32


class Words:
    """The words of a block of texts: byte starts and lengths, document of each, first word of each document, lower-cased bytes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.lower = LOWER_BYTE[data]
        inside = WORD_BYTE[self.lower]
        edge = np.zeros(len(data) + 1, np.int8)
        if len(data):
            edge[1:-1] = inside[1:].astype(np.int8) - inside[:-1]
            edge[0], edge[-1] = inside[0], -int(inside[-1])
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = np.unique(ends[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts  # a word never spans two documents
        if len(cuts):
            starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
        self.starts, self.lengths = starts, stops - starts
        self.first = np.searchsorted(starts, ends)  # of each document, and behind the last
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(ends) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return slice_hashes(lanes(self.lower), self.starts, self.lengths)
