"""Exact dedup by Grace hashing.

Each scan task first folds its own equal texts in an open-addressing table, so a text travels once per task however
often it occurs.  The shuffle by digest is the first Grace level; a task whose share doesn't fit its table partitions it
into spill files by a fresh hash, and those again, until each fits.  Table slots compare complete contents.

Null text counts as empty; empty texts are equal to each other; texts of any length are compared whole; of repeated rows
(same id and text) one is kept; a group whose ids are all null keeps one row; an empty table gives an empty result;
columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import random
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import LOWER, UPPER, ascii_lower, table

#: Bytes of distinct text that one table may hold, spill files of a level, and the levels after which a bucket, by then
#: texts whose hashes collide at every level, is given a table of the size it needs.
TABLE_BYTES, FANOUT, DEPTH = 48 << 20, 16, 6

Entry = tuple[bytes, int | None, int]  # text, largest id, rows


class OpenTable:
    """Linear probing over a power-of-two slot list; equal hashes are told apart by comparing the texts."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.bytes = 0

    def find(self, text: bytes, h: int) -> int:
        mask, slots = len(self.slots) - 1, self.slots
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.texts[k] == text:
                return at
            at = (at + 1) & mask
        return at

    def add(self, text: bytes, top: int | None, n: int, room: int | None = None) -> bool:
        """False, with nothing changed, if a new text doesn't fit into `room` bytes."""
        h = hash(text)
        at = self.find(text, h)
        if (k := self.slots[at]) >= 0:
            if top is not None and (self.ids[k] is None or top > self.ids[k]):
                self.ids[k] = top
            self.counts[k] += n
            return True
        if room is not None and self.texts and self.bytes + len(text) > room:
            return False
        self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.ids.append(top)
        self.counts.append(n)
        self.bytes += len(text) + 200
        if 2 * len(self.texts) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            mask = len(self.slots) - 1
            for k, h in enumerate(self.hashes):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k
        return True

    def entries(self) -> Iterator[Entry]:
        yield from zip(self.texts, self.ids, self.counts, strict=True)


def spilled(folder: str, rows: Iterable[Entry], level: int) -> list[str]:
    """The rows, dealt to files by a hash that differs from level to level."""
    paths = [os.path.join(folder, f"{level}-{i}") for i in range(FANOUT)]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    try:
        for row in rows:
            h = hashlib.blake2b(row[0], digest_size=4, salt=level.to_bytes(8, "little")).digest()
            pickle.dump(row, files[int.from_bytes(h, "little") % FANOUT], pickle.HIGHEST_PROTOCOL)
    finally:
        for f in files:
            f.close()
    return paths


def from_file(path: str) -> Iterator[Entry]:
    with open(path, "rb") as f:
        while f.peek(1):
            yield pickle.load(f)


def grace(rows: Iterable[Entry], room: int = TABLE_BYTES, level: int = 0) -> Iterator[Entry]:
    """One entry per distinct text, in bounded memory."""
    rows, grown = iter(rows), OpenTable()
    for row in rows:
        if not grown.add(*row, room if level < DEPTH else None):
            break
    else:
        yield from grown.entries()
        return
    local = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]  # the executor's disks
    folder = tempfile.mkdtemp(prefix="grace-", dir=random.choice(local) if local else None)
    try:
        def rest() -> Iterator[Entry]:
            yield from grown.entries()
            yield row
            yield from rows

        paths = spilled(folder, rest(), level)
        grown = OpenTable()
        for p in paths:
            yield from grace(from_file(p), room, level + 1)
            os.remove(p)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def folded(rows: Iterable[Entry], room: int = TABLE_BYTES) -> Iterator[Entry]:
    """Equal texts folded as far as one table reaches; a full one is emitted and a new one begun."""
    held = OpenTable()
    for row in rows:
        if not held.add(*row, room):
            yield from held.entries()
            held = OpenTable()
            held.add(*row)
    yield from held.entries()


OUT = pa.schema([("sha", pa.string()), ("body", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])
OUT_DDL = "sha string, body binary, keep_id long, n long"


def kernel(fold: Callable[[Iterable[Entry]], Iterator[Entry]], bodies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Entry]:
            for b in batches:
                for body, top, n in zip(b.column(0), b.column(1), b.column(2), strict=True):
                    yield body.as_py(), top.as_py(), n.as_py()

        held: list[tuple] = []
        size = 0
        for body, top, n in fold(rows()):
            held.append((hashlib.sha256(body).hexdigest(), body if bodies else None, top, n))
            size += len(body) + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)

    return run


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", room: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    body = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"))
    sent = rows.select(F.col("body").cast("binary").alias("body"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = sent.mapInArrow(kernel(lambda r: folded(r, room), True), OUT_DDL)
    groups = local.repartition(F.col("sha")).select("body", "keep_id", "n").mapInArrow(kernel(lambda r: grace(r, room), False), OUT_DDL)
    groups = groups.select(F.col("sha").alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))
    members = rows.select("doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    members = members.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    out = members.join(groups, "text_sha256")
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE_SQL = {
    "op1_exact_dedup": f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as s from documents),
g as (select s, max(doc_id) as keep_id, count(*) as group_size from d group by s)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.s as text_sha256
from d join g using (s)""",
}
