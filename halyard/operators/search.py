"""Vector search: variants against an index, fused by maximum, cut relative to the best and absolutely, ranked."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.config import NOISE, PAGE_SIZE, PREFETCH, Knobs
from halyard.functions.vectors import dot, is_valid, l2_normalize
from halyard.operators.evaluate import part_bounds

#: Bytes of query vectors that go to the executors at once; more queries take more passes over the index.
QUERY_BYTES = 64 << 20


def dense(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix; the caller has filtered out null and invalid ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Scores that a task holds at once, of a batch of rows with some of the queries' vectors.
CELLS = 1 << 20


class Asked:
    """A block of queries' vectors: names, labels, and by length a matrix of variants with where each query's begin."""

    def __init__(self, names: list, vectors: list, labels: list | None = None):
        place: dict[object, int] = {}
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            place.setdefault(names[i], len(place))
            by_length.setdefault(len(v), []).append(i)
        self.place, self.names = place, list(place)
        self.labels = [x for _, x in sorted({place[n]: x for n, x in zip(names, labels, strict=True)}.items())] if labels else []
        self.blocks = {}
        for n, some in by_length.items():
            at = np.array([place[names[i]] for i in some])
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            self.blocks[n] = (np.array([vectors[i] for i in some], np.float64), np.append(first, len(some)), at[first])

    def scored(self, batch: pa.RecordBatch, exclude_self: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of one length, places of some queries, best scores, False where a row is the query itself), CELLS at
        once.  Every query meets all rows of a length together.  batch: key, vector."""
        lengths = batch.column(1).value_lengths().to_numpy()
        for n in np.unique(lengths).tolist():
            if n not in self.blocks:
                continue
            part = batch.filter(pa.array(lengths == n))
            rows, (matrix, first, at) = dense(part.column(1)), self.blocks[n]
            own = [(i, self.place[x]) for i, x in enumerate(part.column(0).to_pylist()) if x in self.place] if exclude_self else []
            own_row, own_at = np.array([i for i, _ in own], np.int64), np.array([j for _, j in own], np.int64)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CELLS // len(rows), "right")) - 1)
                best = np.maximum.reduceat(rows @ matrix[first[lo] : first[hi]].T, first[lo:hi] - first[lo], axis=1)
                other, column = np.ones(best.shape, bool), np.full(len(self.names), -1)
                column[at[lo:hi]] = np.arange(hi - lo)
                here = column[own_at] >= 0
                other[own_row[here], column[own_at[here]]] = False
                yield part, at[lo:hi], best, other
                lo = hi


def asked_blocks(queries: DataFrame, query: str, query_vector: str, query_bytes: int, label: str | None = None) -> Iterator[Asked]:
    """The valid queries in blocks of query_bytes, all variants of a query in one."""
    more = [F.col(label).alias("label")] if label else []
    q = queries.select(F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v"), *more).filter(is_valid("v"))
    size = q.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // query_bytes)) if size > query_bytes else 1
    for b in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        held = sorted(((r["q"], np.array(r["v"]), r["label"] if label else None) for r in part.collect()), key=lambda x: str(x[0]))  # query_bytes at most
        yield Asked([x for x, _, _ in held], [v for _, v, _ in held], [x for _, _, x in held])


def score(index: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "embedding", at_least: float | None = None, first: int | None = None, near: float | None = None, exclude_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, key, score): of every query and index row the best dot product over the query's variants.

    Query rows that share `query` are its variants.  The index is scanned once for each block of queries and never
    shuffled; fusion happens where the row is read.  Rows that can't be results stay there: with `at_least` those that
    score less, but with `first` the best so many of each batch leave the scan whatever they score, unless an earlier
    batch of the task had so many better ones, and without `at_least` only they do; with `near` those below that share of
    the batch's best go too, if that isn't negative.  So the best row of a query always comes along where `first` is
    given.  Equal scores at the end of `first` all come.  Invalid vectors on either side match nothing, and so does one of
    another length than the queries of its block.
    """
    rows = index.select(F.col(key), F.col(vector).alias("v")).filter(is_valid("v"))
    key_type, query_type = index.schema[key].dataType, queries.schema[query].dataType
    schema = T.StructType([T.StructField(query, query_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())])
    prune = Prune(at_least, first, near, exclude_self)
    out = None
    for asked in asked_blocks(queries, query, query_vector, query_bytes):
        found = rows.mapInArrow(scorer(asked, prune, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class Prune:
    """What of a batch's scores, rows by queries, may be a result."""

    at_least: float | None
    first: int | None
    near: float | None
    exclude_self: bool

    def keep(self, best: np.ndarray, other: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """other: False where a row is the query itself.  floor: of each query, what so many of an earlier batch have."""
        if not best.size or (self.first is None and self.at_least is None and self.near is None):
            return other
        best = np.where(other, best, -np.inf)
        keep = np.full(best.shape, self.first is None) if self.at_least is None else best >= self.at_least
        if self.first is not None:
            n = min(self.first, len(best))
            least = np.partition(best, len(best) - n, axis=0)[len(best) - n] if n else np.full(len(floor), np.inf)
            keep |= best >= np.maximum(least, floor)
            if 0 < n == self.first:
                floor[:] = np.maximum(least, floor)
        if self.near is not None:
            top = best.max(axis=0)
            keep &= (best >= top * self.near) | (top < 0)
        return keep & other


#: Arrow's types of names and keys.
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def scorer(asked: Asked, prune: Prune, schema: T.StructType):  # noqa: ANN201
    arrow = pa.schema([pa.field(f.name, KINDS.get(f.dataType.simpleString(), pa.float64())) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, floor = pa.array(asked.names, arrow.field(0).type), np.full(len(asked.names), -np.inf)
        for batch in batches:
            for part, at, best, other in asked.scored(batch, prune.exclude_self):
                least = floor[at]
                r, c = np.nonzero(prune.keep(best, other, least))
                floor[at] = least
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at[c])), part.column(0).take(pa.array(r)), pa.array(best[r, c])], schema=arrow)

    return run


#: Places of the grid on either side of zero that a task counts in arrays; it sends others on from each slice.
SPAN = 1 << 20
RELEVANT = (False, True, None)


def tally(index: DataFrame, queries: DataFrame, width: float, *, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "embedding", label: str = "label", exclude_self: bool = False, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(relevant, score, pairs, off, off2): how many pairs of a query and a row have a score at each place of the grid of
    `width`, and sums of what they are off it and of its squares.  Pairs of one label are relevant.  Counted where rows are
    read, so a task sends a row for each place that it saw."""
    rows = index.select(F.col(key), F.col(vector).alias("v"), F.col(label)).filter(is_valid("v"))
    schema = "relevant boolean, score double, pairs long, off double, off2 double"
    out = None
    for asked in asked_blocks(queries, query, query_vector, query_bytes, label):
        found = rows.mapInArrow(tallier(asked, width, exclude_self), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("relevant", "score").agg(*[F.sum(c).alias(c) for c in ("pairs", "off", "off2")])


def tallier(asked: Asked, width: float, exclude_self: bool):  # noqa: ANN201
    scale = float(round(1 / width))

    def rows(code: np.ndarray, place: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(RELEVANT, pa.bool_()).take(pa.array(code)), pa.array(place / scale), *map(pa.array, sums)], names=["relevant", "score", "pairs", "off", "off2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = 2 * SPAN + 1
        pairs, off, off2 = np.zeros(3 * wide, np.int64), np.zeros(3 * wide), np.zeros(3 * wide)
        codes: dict[object, int] = {}
        asked_codes = np.array([-1 if x is None else codes.setdefault(x, len(codes)) for x in asked.labels])
        for batch in batches:
            for part, at, best, other in asked.scored(batch, exclude_self):
                row_codes, here = np.array([-1 if x is None else codes.get(x, -2) for x in part.column(2).to_pylist()])[:, None], asked_codes[at]
                relevant = np.where((row_codes == -1) | (here == -1), 2, row_codes == here)[other]
                x = best[other]
                place = np.trunc(x / width)
                rest = x / width - place
                place += np.where(np.abs(rest) >= 0.5, np.sign(rest), 0.0)  # halves go away from zero
                rest = x - place / scale
                inside = np.abs(place) <= SPAN
                if not inside.all():
                    far, to = np.unique(np.stack([relevant[~inside], place[~inside]]), axis=1, return_inverse=True)
                    to = to.ravel()
                    yield rows(far[0].astype(np.int64), far[1], np.bincount(to), np.bincount(to, rest[~inside]), np.bincount(to, rest[~inside] ** 2))
                    relevant, place, rest = relevant[inside], place[inside], rest[inside]
                flat = relevant * wide + place.astype(np.int64) + SPAN
                np.add.at(pairs, flat, 1)
                np.add.at(off, flat, rest)
                np.add.at(off2, flat, rest * rest)
        seen = np.flatnonzero(pairs)
        for lo in range(0, len(seen), 1 << 16):
            some = seen[lo : lo + (1 << 16)]
            yield rows(some // wide, some % wide - SPAN, pairs[some], off[some], off2[some])

    return run


#: Rows that all meet are dealt into blocks of about so many bytes of vectors at most, but into up to so many blocks of so
#: many rows for tasks to share; counts are sent for so many places of the grid at once.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS, RUN = 8 << 20, 12, 512, 1 << 14


def pair_tally(rows: DataFrame, width: float, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(relevant, score, pairs): how many pairs of rows with different keys have a score at each place of the grid of `width`.
    Every row meets every other, and either order of a pair counts.  Pairs of one label are relevant; rows without a label or
    key are in no pair.  A score may come in several rows, whose counts add up.

    Rows are dealt into blocks by hash, and each two blocks meet in one group, where one is held while the other streams by.
    Two orders of a pair have one score, so blocks meet once and count twice.  A task adds up all its groups and sends counts
    for runs of the grid, so what is shuffled are blocks and counts, not pairs.
    """
    rows = rows.select(F.col(key), F.col(label), F.col(vector).alias("v")).filter(F.col(key).isNotNull() & F.col(label).isNotNull() & is_valid("v"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes), min(BLOCKS, -(-n // BLOCK_ROWS)))
    dealt = rows.withColumn("_own", F.pmod(F.xxhash64(key, "v"), F.lit(blocks).cast("long")))
    meeting = lambda a, b, visits: F.struct((a * blocks + b).alias("group"), F.lit(visits).alias("visits"))
    own = F.col("_own")
    homes = F.transform(F.sequence(own, F.lit(blocks - 1).cast("long")), lambda b: meeting(own, b, False))
    guests = F.transform(F.sequence(F.lit(0).cast("long"), own), lambda b: meeting(b, own, True))
    met = dealt.select(F.explode(F.concat(homes, guests)).alias("at"), key, label, "v").select("at.group", "at.visits", key, label, "v")
    met = met.repartition(blocks * (blocks + 1) // 2, "group").sortWithinPartitions("group", "visits")
    runs = met.mapInArrow(pair_tallier(width, blocks), "relevant boolean, run long, counts binary, score double, pairs long")
    return runs.repartition("run", "score").mapInArrow(run_adder(width), "relevant boolean, score double, pairs long")


class Block:
    """Rows of one length in order of label."""

    def __init__(self, rows: pa.RecordBatch):
        """rows: key, label, vector."""
        keys, labels = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.argsort(labels, kind="stable")
        self.keys, self.labels, self.matrix = keys[order], labels[order], dense(rows.column(2))[order]
        self.by_key = np.argsort(self.keys, kind="stable")

    def same_key(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in keys, and where in the block, a key is the same."""
        known = self.keys[self.by_key]
        first, last = (np.searchsorted(known, keys, side) for side in ("left", "right"))
        n = last - first
        return np.repeat(np.arange(len(keys)), n), self.by_key[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]

    def same_label(self, labels: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """Stretches of labels, which are in order, and of the block that have one label."""
        edge = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        first, last = (np.searchsorted(self.labels, labels[edge], side) for side in ("left", "right"))
        for lo, hi, a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(labels)], first.tolist(), last.tolist(), strict=True):
            if a < b:
                yield slice(lo, hi), slice(a, b)


def by_length(rows: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """rows: key, label, vector."""
    size = rows.column(2).value_lengths().to_numpy()
    for n in np.unique(size).tolist():
        yield n, rows.filter(pa.array(size == n))


def pair_tallier(width: float, blocks: int):  # noqa: ANN201
    scale = float(round(1 / width))
    schema = pa.schema([("relevant", pa.bool_()), ("run", pa.int64()), ("counts", pa.binary()), ("score", pa.float64()), ("pairs", pa.int64())])

    def places(scores: np.ndarray) -> np.ndarray:
        x = np.divide(scores, width, out=scores)
        place = np.rint(x)
        rest = np.subtract(x, place)
        if rest.size and max(rest.max(), -rest.min()) == 0.5:  # halves go away from zero
            half = np.abs(rest) == 0.5
            place[half] = np.trunc(x[half]) + np.sign(x[half])
        return place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, -(-(2 * SPAN + 1) // RUN) * RUN), np.int64)  # of all pairs and of relevant ones
        far: list[pa.RecordBatch] = []

        def count(which: int, place: np.ndarray, times: int) -> None:
            if not place.size:
                return
            low, high = place.min(), place.max()
            if max(-low, high) > SPAN:
                inside = np.abs(place) <= SPAN
                at, n = np.unique(place[~inside], return_counts=True)
                for relevant, sign in ((True, 1), (False, -1)) if which else ((False, 1),):
                    far.append(pa.RecordBatch.from_pydict({"relevant": [relevant] * len(at), "run": [None] * len(at), "counts": [None] * len(at), "score": at / scale, "pairs": n * (times * sign)}, schema=schema))
                count(which, place[inside], times)
                return
            found = np.bincount((place - low).astype(np.int64))
            counts[which, SPAN + int(low) : SPAN + int(low) + len(found)] += found * times

        def meet(home: Block, guests: Block, times: int) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // len(home.labels))
            for lo in range(0, len(guests.labels), step):
                labels = guests.labels[lo : lo + step]
                place = places(guests.matrix[lo : lo + step] @ home.matrix.T)
                count(0, place.ravel(), times)
                relevant = [place[a, b].ravel() for a, b in home.same_label(labels)]
                count(1, np.concatenate(relevant) if relevant else np.zeros(0), times)
                r, c = home.same_key(guests.keys[lo : lo + step])  # no pairs, so they are taken back
                count(0, place[r, c], -times)
                alike = labels[r] == home.labels[c]
                count(1, place[r[alike], c[alike]], -times)
                yield from far
                far.clear()

        group, parts, homes = None, [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            where, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (visits[1:] != visits[:-1]))).tolist()
            for lo, hi in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if where[lo] != group:
                    group, parts, homes = where[lo], [], {}
                if not visits[lo]:
                    parts.append(part)
                    continue
                if parts:
                    held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    homes, parts = {n: Block(some) for n, some in by_length(held.select([2, 3, 4]))}, []
                for n, some in by_length(part.select([2, 3, 4])):
                    if n in homes:
                        yield from meet(homes[n], Block(some), 1 if group // blocks == group % blocks else 2)
        counts[0] -= counts[1]
        for which, relevant in enumerate((False, True)):
            for at, n in enumerate(counts[which].reshape(-1, RUN)):
                if n.any():
                    small = next(t for t in ("<u1", "<u2", "<u4", "<u8") if int(n.max()) <= np.iinfo(t).max)
                    yield pa.RecordBatch.from_pydict({"relevant": [relevant], "run": [at], "counts": [n.astype(small).tobytes()], "score": [None], "pairs": [None]}, schema=schema)

    return run


def run_adder(width: float):  # noqa: ANN201
    scale = float(round(1 / width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bool, int], np.ndarray] = {}
        for batch in batches:
            alone = pc.is_null(batch.column(1))
            yield batch.filter(alone).select([0, 3, 4])
            for r in batch.filter(pc.invert(alone)).select([0, 1, 2]).to_pylist():
                n = np.frombuffer(r["counts"], f"<u{len(r['counts']) // RUN}")
                sums.setdefault((r["relevant"], r["run"]), np.zeros(RUN, np.int64))[:] += n.astype(np.int64)
        for (relevant, at), n in sums.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([relevant] * len(seen), pa.bool_()), pa.array((at * RUN + seen - SPAN) / scale), pa.array(n[seen])], names=["relevant", "score", "pairs"])

    return run


#: Parts that rows in order of key are cut into at most.
PARTS = 1024


def running_best(index: DataFrame, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "embedding", exclude_self: bool = False, stretch: int = 1000, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, key, best): of every query and index row the best score over rows up to that key.

    Quantiles of the key cut the rows into parts of about `stretch`.  A first scan finds each part's best; in a second the
    parts' rows come in order, after the best of the parts before, so what is shuffled are rows and bests, not pairs.
    """
    rows = index.filter(F.col(key).isNotNull()).select(F.col(key), F.col(vector).alias("v")).filter(is_valid("v"))
    at = F.col(key).cast("double")
    bounds = part_bounds(rows, at, PARTS, stretch)
    rows = rows.withColumn("_part", F.size(F.filter(F.lit(bounds), lambda b: b < at)))
    key_type, query_type = index.schema[key].dataType, queries.schema[query].dataType
    schema = T.StructType([T.StructField(query, query_type), T.StructField(key, key_type), T.StructField("best", T.DoubleType())])
    out = None
    for asked in asked_blocks(queries, query, query_vector, query_bytes):
        tops = rows.mapInArrow(part_tops(asked, exclude_self), "_part int, _at int, top double").groupBy("_part", "_at").agg(F.max("top").alias("top"))
        before = F.max("top").over(Window.partitionBy("_at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        carried = tops.select("_part", "_at", before.alias("top")).filter("top is not null").groupBy("_part").agg(F.collect_list(F.struct("_at", "top")).alias("c"))
        carried = carried.select("_part", F.lit(None).cast(key_type).alias(key), F.lit(None).cast(index.schema[vector].dataType).alias("v"), F.col("c")["_at"].alias("_at"), F.col("c")["top"].alias("_top"))
        given = rows.select("_part", key, "v", F.lit(None).cast("array<int>").alias("_at"), F.lit(None).cast("array<double>").alias("_top"))
        ordered = given.unionByName(carried).repartition("_part").sortWithinPartitions("_part", F.asc_nulls_first(key))
        found = ordered.mapInArrow(runner(asked, exclude_self, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def part_tops(asked: Asked, exclude_self: bool):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, best, other in asked.scored(batch, exclude_self):
                number = part.column(2).to_numpy()
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(number[order]) != 0))
                top = np.maximum.reduceat(np.where(other, best, -np.inf)[order], first, axis=0)
                r, c = np.nonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(number[order][first][r], pa.int32()), pa.array(at[c], pa.int32()), pa.array(top[r, c])], names=["_part", "_at", "top"])

    return run


def runner(asked: Asked, exclude_self: bool, schema: T.StructType):  # noqa: ANN201
    arrow = pa.schema([pa.field(f.name, KINDS.get(f.dataType.simpleString(), pa.float64())) for f in schema])

    def bests(rows: pa.RecordBatch, carry: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
        """rows: in order of key, all with a key together.  carry: of each query, the best so far."""
        for part, at, best, other in asked.scored(rows.select([1, 2]), exclude_self):
            so_far = np.maximum.accumulate(np.where(other, best, -np.inf), axis=0)
            so_far = np.maximum(so_far, carry[at])
            carry[at] = so_far[-1]
            keys = part.column(0)
            if len(keys) > 1:
                last = np.append(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False), True)
                so_far = so_far[np.flatnonzero(last)[np.cumsum(np.append(0, last[:-1]))]]  # rows of one key share its best
            r, c = np.nonzero(other)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[c])), keys.take(pa.array(r)), pa.array(so_far[r, c])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(asked.names, arrow.field(0).type)
        now, carry, held = None, np.zeros(0), None
        for batch in batches:
            if held is not None:  # rows whose key the next batch may have too
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            number = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist() if batch.num_rows else []
            for lo, hi in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if number[lo] != now:
                    now, carry = number[lo], np.full(len(names), -np.inf)
                if not part.column(1)[0].is_valid:
                    carry[np.array(part.column(3)[0].as_py())] = part.column(4)[0].as_py()
                    part = part.slice(1)
                if hi == batch.num_rows and part.num_rows:
                    keys = part.column(1)
                    same = pc.equal(keys, keys[-1]).to_numpy(zero_copy_only=False)
                    cut = len(same) - int(np.argmin(np.append(same[::-1], False)))
                    held, part = part.slice(cut), part.slice(0, cut)
                if part.num_rows:
                    yield from bests(part, carry, names)
        if held is not None:
            yield from bests(held, carry, names)

    return run


def best_per_query(query: str = "query_id") -> Column:
    return F.max("score").over(Window.partitionBy(query))


def ranked(scores: DataFrame, *, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """scores with rank from 1 in each query; equal scores in order of key."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.col(key))
    return scores.withColumn("rank", F.row_number().over(order).cast("long"))


def cut(scores: DataFrame, knobs: Knobs = Knobs(), *, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The results of each query, ranked: relative to its best, then absolutely, then the first top_k; where the
    threshold leaves none, the first `fallback` of those near the best."""
    near = scores.withColumn("best", best_per_query(query)).filter(F.col("score") >= F.col("best") * knobs.ratio)
    passes = F.col("score") >= knobs.threshold if knobs.inclusive else F.col("score") > knobs.threshold
    if not knobs.fallback:
        out = ranked(near.filter(passes), query=query, key=key)
        return out.filter(F.col("rank") <= knobs.top_k) if knobs.top_k else out
    near = ranked(near.withColumn("passes", passes), query=query, key=key)  # passing rows are the first ranks
    near = near.withColumn("any_passes", F.max("passes").over(Window.partitionBy(query)))
    limit = F.when(F.col("any_passes"), knobs.top_k or (1 << 62)).otherwise(knobs.fallback)
    return near.filter((F.col("rank") <= limit) & (F.col("passes") == F.col("any_passes"))).drop("passes", "any_passes")


def search(index: DataFrame, queries: DataFrame, knobs: Knobs = Knobs(), **options: object) -> DataFrame:
    """query, key, score, best, rank.  A result passes the threshold or is among the first `fallback`, and is near the best,
    so nothing else need leave the scan."""
    names = {k: options[k] for k in ("query", "key") if k in options}
    few = knobs.fallback or None
    return cut(score(index, queries, at_least=knobs.threshold, first=few, near=knobs.ratio, **options), knobs, **names)


def top_k(scores: DataFrame, k: int = 20, *, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The first k of each query; Spark keeps k rows of a query in each task before the shuffle."""
    return ranked(scores, query=query, key=key).filter(F.col("rank") <= k)


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, *, query: str = "query_id", key: str = "vec_id", **options: object) -> DataFrame:
    """The first k rows of the index for each query; no more of a batch leave the scan."""
    return top_k(score(index, queries, query=query, key=key, first=k, **options), k, query=query, key=key)


def image_to_image(index: DataFrame, probes: DataFrame, knobs: Knobs = Knobs(), *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Stored vectors as queries; a row is no result of its own.  Every QUERY_BYTES of probes are one more scan of the
    index, so work grows with probes times rows."""
    queries = probes.select(F.col(key).alias("query_id"), vector)
    return search(index, queries, knobs, key=key, vector=vector, query_vector=vector, exclude_self=True)


def two_stage(index: DataFrame, heads: DataFrame, queries: DataFrame, knobs: Knobs = Knobs(), *, candidates: int = 200, key: str = "vec_id", exclude_self: bool = False) -> DataFrame:
    """Candidates are the first rows of each query's head scores, and its full scores rank them.  A query without a head
    is its own.  Only candidates get full scores: they are joined to the index and their query's variants."""
    orphans = queries.join(heads.select("query_id").distinct(), "query_id", "left_anti").select(*heads.columns)
    pool = nearest(index, heads.unionByName(orphans), candidates, key=key, exclude_self=exclude_self).select("query_id", key)
    rows = pool.join(index.select(key, F.col("embedding").cast("array<double>").alias("_row")), key)
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_asked")).filter(is_valid("_asked"))
    scores = rows.join(asked, "query_id").filter(F.size("_row") == F.size("_asked")).groupBy("query_id", key).agg(F.max(dot("_row", "_asked")).alias("score"))
    return cut(scores, knobs, key=key)


#: Vectors of a cell that a task holds while all that may be near them stream by.
HOME_ROWS = 1024
#: Tasks that deal with the copies of one vector.
SALTS = 64


def near_duplicates(index: DataFrame, at_least: float = 0.97, *, key: str = "vec_id", vector: str = "embedding", pivots: int = 2, recall: float | None = None) -> DataFrame:
    """(a, b, score) of unit vectors, a < b, with dot product at_least.  Equal vectors are one: each links to the least
    key that has it, and only that one to others, so a group of copies costs a row for each.

    Exact without `recall`: such vectors are at most r = sqrt(2 - 2 at_least) apart, and so are their projections on any
    unit vector.  Rows live in cells of width r along `pivots` coordinate directions and visit the neighbouring ones, so
    near vectors meet.  That prunes where coordinates spread wider than r; in hundreds of dimensions they don't, few cells
    remain, and the work tends to all pairs, as it must for low thresholds.

    With `recall`, that share of the pairs is found at least, on average: vectors meet that lie on the same sides of some
    random planes.  A band has as many planes as deal the counted rows to groups of HOME_ROWS, and there are as many
    bands as a pair right at the threshold needs to meet in one.

    In either way a cell's inhabitants are dealt into blocks of about HOME_ROWS by its counted size; a task holds a block
    and multiplies it with the visitors as they stream by, so a crowded cell costs more tasks, not more memory.
    """
    key_type = index.schema[key].dataType
    every = index.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(is_valid("v"))
    classes = every.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rows = classes.select("id", "v")
    # a vector on any number of rows meets its class in SALTS tasks
    salted = classes.filter("n > 1").select(F.col("id").alias("a"), "v", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["v", "salt"]).filter(F.col("id") != F.col("a"))
    copies = copies.select("a", F.col("id").alias("b"), dot("v", "v").alias("score")).filter(F.col("score") >= at_least)
    if recall is None:
        r = max((2 - 2 * at_least) ** 0.5, 1e-6) * (1 + 1e-9)
        at = [F.floor(F.element_at("v", i + 1) / r).cast("long") for i in range(pivots)]
        homes = rows.withColumn("cell", F.array(*at))
        around = F.array(*[F.array(*[c + d for c, d in zip(at, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=pivots)])
        guests = rows.select(F.explode(around).alias("cell"), "id", "v")
    else:
        homes = guests = banded(rows, at_least, recall)
    sizes = homes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / HOME_ROWS).cast("int").alias("blocks"))
    homes = homes.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("visits"), "id", "v")
    guests = guests.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "id", "v")
    met = homes.unionByName(guests).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits")
    schema = T.StructType([T.StructField("a", key_type), T.StructField("b", key_type), T.StructField("score", T.DoubleType())])
    found = met.select(F.xxhash64("cell", "block").alias("group"), "visits", "id", "v").mapInArrow(pair_kernel(at_least), schema)
    if recall is not None:  # a pair may meet in several bands
        found = found.groupBy("a", "b").agg(F.max("score").alias("score"))
    return found.unionByName(copies)


def band_plan(rows: int, at_least: float, recall: float) -> tuple[int, int]:
    """Planes of a band, and how many bands."""
    agree = 1 - math.acos(max(-1.0, min(1.0, at_least))) / math.pi  # that a plane has a pair on one side
    planes = min(30, max(1, math.ceil(math.log2(max(2, rows / HOME_ROWS)))))
    miss = 1 - agree**planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(miss))) if miss > 0 else 1


def banded(rows: DataFrame, at_least: float, recall: float) -> DataFrame:
    """rows once for each band, with the cell (length, band, sides of its planes)."""
    planes, bands = band_plan(rows.count(), at_least, recall)
    schema = T.StructType([T.StructField("cell", T.ArrayType(T.LongType())), *rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(size).tolist():
                part = batch.filter(pa.array(size == n))
                if n not in drawn:
                    drawn[n] = np.random.default_rng(n).normal(size=(n, planes * bands))
                sides = ((dense(part.column(1)) @ drawn[n]) > 0).reshape(part.num_rows, bands, planes)
                marks = sides.astype(np.int64) @ (1 << np.arange(planes, dtype=np.int64))
                for b in range(bands):
                    flat = np.stack([np.full(part.num_rows, n), np.full(part.num_rows, b), marks[:, b]], 1).ravel()
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 3), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([cells, *part.columns], names=["cell", *part.schema.names])

    return rows.mapInArrow(run, schema)


def pair_kernel(at_least: float):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, names, held = None, [], [], {}
        for batch in batches:
            where, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (visits[1:] != visits[:-1]))).tolist()
            for lo, hi in zip(edge, [*edge[1:], batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if where[lo] != group:
                    group, parts, names, held = where[lo], [], [], {}
                if not visits[lo]:
                    parts.append(part)
                    continue
                if parts:  # the block's inhabitants have all come: by length, as vectors of different lengths aren't compared
                    home = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    size = home.column(3).value_lengths().to_numpy()
                    for n in np.unique(size).tolist():
                        some = home.filter(pa.array(size == n))
                        held[n] = (some.column(2), dense(some.column(3)))
                    parts = []
                size = part.column(3).value_lengths().to_numpy()
                for n in np.unique(size).tolist():
                    if n not in held:
                        continue
                    guests = part.filter(pa.array(size == n))
                    ids, matrix = held[n]
                    scores = matrix @ dense(guests.column(3)).T
                    i, j = np.nonzero(scores >= at_least)
                    a, b = ids.take(pa.array(i)), guests.column(2).take(pa.array(j))
                    keep = pc.less(a, b)
                    yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), pa.array(scores[i, j]).filter(keep)], names=["a", "b", "score"])

    return run


# The four strategies that are compared, and their knobs.
STRATEGIES = {
    "S1_current": Knobs(0.19, 0.75, 10, 0),
    "S2_loose": Knobs(0.15, 0.55, 50, 10, False),
    "S3_ensemble": Knobs(0.15, 0.55, 50, 10, False),
    "S4_twostage": Knobs(0.15, 0.55, 50, 10, False),
}


def ensemble(queries: DataFrame, *, query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Each query's variants as one: their element-wise mean at length one."""
    items = queries.filter(is_valid(vector)).select(query, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = items.groupBy(query, "i").agg(F.avg("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"])
    return means.groupBy(query).agg(mean.alias("m")).select(query, l2_normalize("m").alias(vector))


def strategy(name: str, index: DataFrame, queries: DataFrame, heads: DataFrame, *, key: str = "vec_id", exclude_self: bool = False) -> DataFrame:
    """One of STRATEGIES: maximum over variants, the same with loose knobs, the mean of variants, or that in two stages."""
    knobs = STRATEGIES[name]
    if name in ("S1_current", "S2_loose"):
        return search(index, queries, knobs, key=key, exclude_self=exclude_self)
    if name == "S3_ensemble":
        return search(index, ensemble(queries), knobs, key=key, exclude_self=exclude_self)
    return two_stage(index, ensemble(heads), ensemble(queries), knobs, key=key, exclude_self=exclude_self)


def is_noise(score: Column | str, below: float = NOISE) -> Column:
    """Whether a score tells nothing."""
    return (F.col(score) if isinstance(score, str) else score) < below


def score_matrix(texts: DataFrame, images: DataFrame, *, text: str = "query", name: str = "name") -> DataFrame:
    """(query, name, score) of every text with every image; texts go out in blocks, images are scanned."""
    return score(images, texts, key=name, query=text)


#: Rows of the index that a piece of a report covers; reports are written in so many groups of queries at least, of about
#: so many bytes of text, but not of fewer than so many queries.
PIECE, GROUPS, GROUP_BYTES, GROUP_QUERIES = 1024, 64, 16 << 20, 8
#: Scores with four decimals by number of ten-thousandths, from NO_SIGN on, which is a negative one that rounds to zero.
NO_SIGN = -(1 << 15)


def ten_thousandths(x: np.ndarray) -> np.ndarray | None:
    """x rounded as '%.4f' does; None if some are too large for 16 bits."""
    if np.abs(x).max(initial=0) > 3.27:
        return None
    y = x * 1e4
    out = np.rint(y)
    for i in np.flatnonzero(np.abs(np.abs(y - np.trunc(y)) - 0.5) < 1e-6):
        out[i] = round(float(f"{x[i]:.4f}") * 1e4)
    return np.where((out == 0) & np.signbit(x), NO_SIGN, out).astype("<i2")


def score_report(texts: DataFrame, images: DataFrame, *, text: str = "query", name: str = "name", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Per query the best score, its name, the last of equals, and all scores by name as name=0.1234,name=...

    Images are ordered by name and scored in pieces.  A piece's scores go on in 16 bits each, its names once for each
    group of queries.  A task forms one query's text at a time, and has a few groups, as a file's writer may hold all
    texts of its task.  Names must not be null."""
    rows = images.select(F.col(name), F.col(vector).alias("v")).filter(is_valid("v"))
    most = GROUP_BYTES // (16 * max(1, rows.count()))
    rows = rows.repartitionByRange(name).sortWithinPartitions(name)
    pieces = "g int, q string, first string, seq int, best double, best_name string, codes binary, texts array<string>"
    out = None
    for asked in asked_blocks(texts, text, vector, query_bytes):
        some = max(GROUP_QUERIES, min(most, -(-len(asked.names) // GROUPS)))
        groups = max(1, -(-len(asked.names) // some))
        found = rows.mapInArrow(report_pieces(asked, groups), pieces)
        dealt = found.repartition(groups, "g").sortWithinPartitions("g", F.asc_nulls_first("q"), "first", "seq")
        written = dealt.mapInArrow(report_writer, f"`{text}` string, best_score double, best_name string, matches string")
        out = written if out is None else out.unionByName(written)
    return out


def report_pieces(asked: Asked, groups: int):  # noqa: ANN201
    arrow = pa.schema([("g", pa.int32()), ("q", pa.string()), ("first", pa.string()), ("seq", pa.int32()), ("best", pa.float64()), ("best_name", pa.string()), ("codes", pa.binary()), ("texts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, last = 0, None
        for batch in batches:
            for lo in range(0, batch.num_rows, PIECE):
                for part, at, best, _ in asked.scored(batch.slice(lo, PIECE), False):
                    names = part.column(0).to_pylist()
                    if part is not last:  # its names, for each group; no query stands before all
                        last, seq = part, seq + 1
                        for g in range(groups):
                            yield pa.RecordBatch.from_pylist([{"g": g, "first": names[0], "seq": seq, "texts": names}], schema=arrow)
                    top = len(names) - 1 - np.argmax(best[::-1], axis=0)
                    out = []
                    for j, place in enumerate(at.tolist()):
                        x = np.ascontiguousarray(best[:, j])
                        codes = ten_thousandths(x)
                        shown = {"texts": [f"{v:.4f}" for v in x.tolist()]} if codes is None else {"codes": codes.tobytes()}
                        out.append({"g": place % groups, "q": asked.names[place], "first": names[0], "seq": seq, "best": float(x[top[j]]), "best_name": names[top[j]], **shown})
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def report_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shown = pa.array(["-0.0000", *[f"{i / 1e4:.4f}" for i in range(NO_SIGN + 1, -NO_SIGN)]])
    group, names, query, parts, best = None, {}, None, [], (float("-inf"), None)

    def text() -> pa.RecordBatch:
        entries = pa.concat_arrays(parts)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries), ",")
        return pa.RecordBatch.from_arrays([pa.array([query]), pa.array([best[0]]), pa.array([best[1]]), joined], names=["query", "best_score", "best_name", "matches"])

    for batch in batches:
        g, q, first, seq, score, best_name, codes, texts = batch.columns
        for i in range(batch.num_rows):
            asked, piece = q[i].as_py(), (first[i].as_py(), seq[i].as_py())
            if asked != query and parts:
                yield text()
                parts, best = [], (float("-inf"), None)
            query = asked
            if asked is None:
                if g[i].as_py() != group:
                    group, names = g[i].as_py(), {}
                names[piece] = texts[i].values
                continue
            values = shown.take(pa.array(np.frombuffer(codes[i].as_py(), "<i2").astype(np.int64) - NO_SIGN)) if codes[i].is_valid else texts[i].values
            parts.append(pc.binary_join_element_wise(names[piece], values, "="))
            if score[i].as_py() >= best[0]:
                best = (score[i].as_py(), best_name[i].as_py())
    if parts:
        yield text()


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number`, from 0; past the last it is empty."""
    return results.filter((F.col("rank") > number * size) & (F.col("rank") <= (number + 1) * size))


def needs_next_page(last_visible: Column, shown: Column) -> Column:
    """Whether the rows in sight end near the last of those shown."""
    return last_visible >= shown - PREFETCH


def with_page(results: DataFrame, *, query: str = "query_id", size: int = PAGE_SIZE) -> DataFrame:
    """results with their page and whether it is the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy(query))
    number = F.floor((F.col("rank") - 1) / size).cast("long")
    return results.withColumn("page", number).withColumn("is_last_page", (F.col("page") + 1) * size >= n)


def hybrid(scores: DataFrame, words: DataFrame, *, alpha: float = 0.7, beta: float = 0.3) -> DataFrame:
    """alpha * cosine + beta * word score, a missing one counting as zero."""
    both = scores.join(words, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) * alpha + F.coalesce("bm25", F.lit(0.0)) * beta).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, bm25) of docs(doc_id, words) that hold a word of queries(query_id, words)."""
    terms = docs.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("word"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg_length"))
    found = terms.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rows = found.join(df, "word").join(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return rows.join(wanted, "word").groupBy("query_id", "doc_id").agg(F.sum(idf * tf).alias("bm25"))
