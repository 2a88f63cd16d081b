"""Repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of `width` bytes over it starts anywhere else too.  Only the first `width` bytes of suffixes
matter, so a suffix array here is sorted by those bytes, and only suffixes that can match are put in one:

1.  Equal texts travel as one.  Each text is cut at anchors: of the 32-byte strings in a window of `width` bytes the one
    of least hash, the first of equals.  Equal windows have their anchor at the same place, so windows whose anchor
    string occurs once in all texts match nothing and are left out.
2.  The rest travel to their anchor's task as the bytes around it, and come in order of their anchors.  A task takes them
    in batches: each batch gets its suffix array, within each anchor in order of the bytes, is merge-scanned against the
    arrays of all levels, and is added as a level; equal levels merge, so their sizes grow geometrically.  Matches are
    equal bytes.  A matched window is given out at once and only its first occurrence is held, so a level holds distinct
    windows; those of anchors that the batches have passed leave it, so it holds one anchor's at most, and a batch.
3.  Matched windows go back to their text, which drops the union of what they cover.

Equal anchors, equal bytes around them and equal windows are folded within a task before they travel, so a group of
copies costs two rows for each task.  An anchor with very many different surroundings would send them all to one task;
its windows go to tasks by their own hashes instead, without their bytes, and match by 128 bits of hash.

Null text counts as empty; a text shorter than `width` keeps all bytes; a text that occurs in several rows, repeated
rows included, is all repeated if it is `width` long; texts are read whole, long ones in overlapping segments, and a text's
anchors and runs are one row, as it is itself; matches never cross documents; an empty table gives an empty result;
columns besides id and text are ignored; a width under 32 is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import M1, M2, M3, materialize, mix, string_parts, table, text_blocks

WIDTH, GRAM = 200, 32
#: Bytes that are hashed at once; a longer text is taken in segments that overlap by a window.
BLOCK = 1 << 20
#: Anchors of a scan task that are folded before they are sent.
ANCHORS = 2_000_000
#: An anchor that occurs so often sends its windows to tasks by their own hashes rather than all to one.
HOT = 512

#: Windows of a batch.
BATCH = 50_000

BYTE_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M1)
OTHER_HASH = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M3)


def doubled(h: np.ndarray, k: int, m: np.uint64 = M2) -> np.ndarray:
    """Hashes of 2k bytes at each place from those of k bytes."""
    x = h[:-k] * m
    x += h[k:]
    x ^= x >> np.uint64(29)
    x *= M1
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the GRAM bytes at each place where as many are left."""
    h, k = BYTE_HASH[data], 1
    while k < GRAM:
        h, k = doubled(h, k), 2 * k
    return mix(h)


def window_hashes(data: np.ndarray, width: int, of_byte: np.ndarray = BYTE_HASH, m: np.uint64 = M2) -> np.ndarray:
    """Of the `width` bytes at each place: the hashes of its binary parts, one after the other."""
    n = len(data) - width + 1
    out, at, h, k = np.full(n, width, np.uint64) * M1, 0, of_byte[data], 1
    while True:
        if width & k:
            out = mix(out ^ h[at : at + n])
            at += k
        if 2 * k > width:
            return out
        h, k = doubled(h, k, m), 2 * k


def segments(texts: list[bytes], width: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text, offset, bytes); every window lies in exactly one segment."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - width + 1), BLOCK):
            part = t[at : at + BLOCK + width - 1]
            if held and size + len(part) > BLOCK:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def anchors(block: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    """Text, first window, windows and anchor hash of each anchor of a block."""
    data = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
    sizes = np.array([len(p) for _, _, p in block])
    begins = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.view(np.uint64)
    gram = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span, k = width - GRAM + 1, 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if k < span:
        least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
    windows = np.maximum(sizes - width + 1, 0)
    start = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    at = (least[start] & low).astype(np.int64)
    owner = np.repeat(np.arange(len(block)), windows)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))) if len(at) else none
    n = np.diff(np.append(first, len(at)))
    own = owner[first]
    text, offset = np.array([i for i, _, _ in block]), np.array([o for _, o, _ in block])
    return text[own], start[first] - begins[own] + offset[own], n, gram[at[first]]


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


TEXTS = pa.schema([("sha", pa.string()), ("z", pa.binary())])


def send_texts(width: int) -> Kernel:
    """(sha, compressed bytes) of texts of a window or more, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for _, data, ends in text_blocks(batches, "text"):
            raw, at, out = data.tobytes(), ends.tolist(), []
            for a, b in zip(at, at[1:], strict=False):
                if b - a < width:
                    continue
                digest = hashlib.sha256(raw[a:b]).digest()
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest.hex(), press.compress(raw[a:b])))
            if out:
                yield batch(TEXTS, *zip(*out, strict=True))

    return run


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once; all rows of a sha are in one task."""
    seen: set[bytes] = set()
    for b in batches:
        digests = [bytes.fromhex(sha) for sha in b.column(0).to_pylist()]
        fresh = []
        for d in digests:
            fresh.append(d not in seen)
            seen.add(d)
        yield b.filter(pa.array(fresh, pa.bool_()))


def unpacked(batches: Iterator[pa.RecordBatch], column: str = "z", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts have `limit` bytes or are one, and those texts."""
    press = zstandard.ZstdDecompressor()
    for b in batches:
        z, held, size, first = b.column(b.schema.get_field_index(column)), [], 0, 0
        for i, x in enumerate(z):
            held.append(press.decompress(x.as_py()))
            size += len(held[-1])
            if size >= limit:
                yield b.slice(first, i + 1 - first), held
                held, size, first = [], 0, i + 1
        if held:
            yield b.slice(first, len(held)), held


ANCHOR = pa.schema([("to", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("copies", pa.int64())])
ANCHOR_DDL = "to long, key long, id long, at long, n int, copies long"


def folded_anchors(key: np.ndarray, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The first of each key goes to that key's task, with how many it stands for; the others are known to repeat and go
    to tasks that spread them.  at, n: first window, windows."""
    order = np.argsort(key, kind="stable")
    key, text, start, n = key[order], text[order], start[order], n[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    copies = np.zeros(len(key), np.int64)
    copies[first] = np.diff(np.append(first, len(key)))
    to = np.where(new, key, mix(text.astype(np.uint64) * M1 ^ start.astype(np.uint64) * M2))
    return batch(ANCHOR, to.view(np.int64), key.view(np.int64), text, start, n.astype(np.int32), copies)


def send_anchors(width: int) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part, texts in unpacked(batches):
            ids = part.column(0).to_numpy()
            for block in segments(texts, width):
                text, start, n, key = anchors(block, width)
                held.append((key, ids[text], start, n))
            if sum(len(x[0]) for x in held) > ANCHORS:
                yield folded_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if sum(len(x[0]) for x in held):
            yield folded_anchors(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


REPEATED = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("key", pa.int64())])
REPEATED_DDL = "id long, at long, n int, key long"


def repeated_anchors(hot: int) -> Kernel:
    """From anchors in order of their keys: those whose key is known to repeat, or now seen to; and a row of id -1 for each
    key of `hot` anchors or more.  A key's rows here are one for each flush of a scan task, the others are elsewhere."""

    def judged(key: np.ndarray, text: np.ndarray, at: np.ndarray, n: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(copies, first)
        many = key[first[total >= hot]]
        if len(many):
            yield batch(REPEATED, np.full(len(many), -1), np.zeros(len(many), np.int64), np.zeros(len(many), np.int32), many)
        pick = np.repeat(total, np.diff(np.append(first, len(key)))) > 1
        yield batch(REPEATED, text[pick], at[pick], n[pick], key[pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()
        for b in batches:
            _, key, text, at, n, copies = (c.to_numpy() for c in b.columns)
            known = copies == 0
            if known.any():
                yield batch(REPEATED, text[known], at[known], n[known], key[known])
            own = tuple(x[~known] for x in (key, text, at, n, copies))
            held = tuple(np.concatenate(x) for x in zip(held, own, strict=True)) if held else own
            if len(held[0]):
                done = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on
                yield from judged(*(x[:done] for x in held))
                held = tuple(x[done:] for x in held)
        if held:
            yield from judged(*held)

    return run


CONTEXT = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
CONTEXT_DDL = "key long, more long, id long, start long, n long, body binary"


class Folded:
    """What a task has sent.  Of equal ones two are sent, so that where they meet the first is seen to repeat; any more
    are results already, and so is the second."""

    def __init__(self, limit: int):
        self.seen: dict[object, bool] = {}
        self.limit = limit

    def __call__(self, mark: object) -> tuple[bool, bool]:
        """Whether to send it, and whether it is known to repeat."""
        if len(self.seen) > self.limit:
            self.seen = {}
        again = self.seen.get(mark)
        self.seen[mark] = again is not None
        return not again, again is not None


def send_contexts(width: int) -> Kernel:
    """From (id, sha, z, found): the bytes of the windows around each repeated anchor, to its key's task; around a hot
    one each window by itself, to a task by its own hash, with as much hash again.  Known results go as rows without either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, windows = Folded(ANCHORS // 4), Folded(ANCHORS)
        for part, texts in unpacked(batches):
            found = part.column(3)
            rows = found.flatten()
            at, n, key = (rows.field(x).to_numpy() for x in ("at", "n", "key"))
            hot = rows.field("hot").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(part.num_rows), found.value_lengths().to_numpy())
            ids = part.column(0).to_numpy()[owner]
            out: list[tuple] = []
            for i, d, s, m, k, h in zip(owner.tolist(), ids.tolist(), at.tolist(), n.tolist(), key.tolist(), hot.tolist(), strict=True):
                body = texts[i][s : s + m - 1 + width]
                send, known = contexts(hashlib.blake2b(body, digest_size=16).digest())
                if known:
                    out.append((spread_key(d, s), 0, d, s, m, None))
                if not send:
                    continue
                if not h:
                    out.append((k, 0, d, s, m, body))
                    continue
                raw = np.frombuffer(body, np.uint8)
                prints = (x.view(np.int64).tolist() for x in (window_hashes(raw, width), window_hashes(raw, width, OTHER_HASH, M3)))
                for j, fp in enumerate(zip(*prints, strict=True)):
                    send, known = windows(fp)
                    if known:
                        out.append((spread_key(d, s + j), 0, d, s + j, 1, None))
                    if send:
                        out.append((*fp, d, s + j, 0, None))
            if out:
                yield batch(CONTEXT, *zip(*out, strict=True))

    return run


def spread_key(text: int, start: int) -> int:
    return hash((text, start)) & 0x7FFFFFFFFFFFFFFF


def records(key: np.ndarray, data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each window: its anchor's key, its own bytes, and zeros up to whole lanes.  Their order is that
    of a suffix array within each anchor."""
    out = np.zeros((len(starts), 8 + -(-width // 8) * 8), np.uint8)
    out[:, :8] = (key.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)  # signed order
    if len(starts):
        out[:, 8 : 8 + width] = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    return out


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as values that numpy compares byte by byte."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0]


def same_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(a).view(np.uint64) == np.ascontiguousarray(b).view(np.uint64)).all(1)


class Levels:
    """Suffix arrays of distinct windows in geometric sizes: records, text, place, and whether each has repeated."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of the batch's windows that repeat an earlier one, here or in a level."""
        order = np.argsort(as_keys(rows), kind="stable")
        rows, text, at = rows[order], text[order], at[order]
        new = np.append(True, ~same_rows(rows[1:], rows[:-1]))
        again = np.append(~new[1:], False) & new  # the first of several equal ones here
        old, keys = np.zeros(len(rows), bool), as_keys(rows)
        for _, held, _, _, hit in self.levels:
            j = np.minimum(np.searchsorted(as_keys(held), keys), len(held) - 1)
            eq = same_rows(held[j], rows)
            hit[j[eq]] = True
            old |= eq
        out = old | ~new
        keep = ~out
        rank, level = 0, (rows[keep], text[keep], at[keep], again[keep])
        while self.levels and self.levels[-1][0] <= rank:
            r, *other = self.levels.pop()
            both = [np.concatenate(x) for x in zip(other, level, strict=True)]
            order = np.argsort(as_keys(both[0]), kind="stable")  # two sorted runs
            level, rank = tuple(x[order] for x in both), max(r, rank) + 1
        if len(level[0]):
            self.levels.append((rank, *level))
        return text[out], at[out]

    def passed(self, key: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and place of windows that have repeated, of keys before this one or all; these keys are held no longer."""
        kept = []
        for rank, rows, text, at, hit in self.levels:
            cut = len(rows)
            if key is not None:
                own = np.ascontiguousarray(rows[:, :8]).view(">u8")[:, 0].astype(np.uint64)
                cut = int(np.searchsorted(own, np.uint64((key + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)))
            yield text[:cut][hit[:cut]], at[:cut][hit[:cut]]
            if cut < len(rows):
                kept.append((rank, rows[cut:], text[cut:], at[cut:], hit[cut:]))
        self.levels = kept


RUNS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def runs_of(text: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, text))
    text, at = text[order], at[order]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)))
    return batch(RUNS, text[first], at[first], np.diff(np.append(first, len(at))))


def equal_prints(key: np.ndarray, more: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place of windows whose both hashes occur again."""
    order = np.lexsort((more, key))
    key, more, text, at = key[order], more[order], text[order], at[order]
    same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
    hit = np.append(False, same) | np.append(same, False) if len(key) else same
    return text[hit], at[hit]


def match_windows(width: int) -> Kernel:
    """From contexts and single windows in order of their keys, all of a key in one task: runs of windows that repeat."""

    def found(text: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(text):
            yield runs_of(text, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, single = Levels(), None
        for b in batches:
            key, more, text, start, n = (b.column(i).to_numpy() for i in range(5))
            bare = pc.is_null(b.column(5)).to_numpy(zero_copy_only=False)
            given, alone = bare & (n > 0), bare & (n == 0)
            if given.any():
                yield batch(RUNS, text[given], start[given], n[given])
            if alone.any():
                own = tuple(x[alone] for x in (key, more, text, start))
                single = tuple(np.concatenate(x) for x in zip(single, own, strict=True)) if single else own
                done = int(np.searchsorted(single[0], single[0][-1]))  # the last key may go on
                yield from found(*equal_prints(*(x[:done] for x in single)))
                single = tuple(x[done:] for x in single)
            if bare.all():
                continue
            data, ends = string_parts(b.column(5).filter(pa.array(~bare)))
            k, t, s, m = (x[~bare] for x in (key, text, start, n))
            total = np.cumsum(m)
            lo = 0
            while lo < len(m):
                hi = max(lo + 1, int(np.searchsorted(total, BATCH + (total[lo - 1] if lo else 0), "right")))
                c = m[lo:hi]
                inner = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                places = np.repeat(ends[lo:hi], c) + inner
                rows = records(np.repeat(k[lo:hi], c), data, places, width)
                yield from found(*family.add(rows, np.repeat(t[lo:hi], c), np.repeat(s[lo:hi], c) + inner))
                for x in family.passed(int(k[hi - 1])):
                    yield from found(*x)
                lo = hi
        if single:
            yield from found(*equal_prints(*single))
        for x in family.passed():
            yield from found(*x)

    return run


KEPT = pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
KEPT_DDL = "sha string, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def union(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that the intervals cover; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    return start[new], stop[np.append(new[1:], len(start)) - 1]


def cut_texts(width: int) -> Kernel:
    """From (id, sha, z, runs): what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in unpacked(batches):
            out = []
            for sha, text, found in zip(part.column(1).to_pylist(), texts, part.column(3), strict=True):
                rows = found.values
                a, b = union(rows.field("start").to_numpy(), rows.field("start").to_numpy() + rows.field("n").to_numpy() - 1 + width)
                keep, last = hashlib.sha256(), 0
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    keep.update(text[last:s])
                    last = e
                keep.update(text[last:])
                out.append((sha, int((b - a).sum()), len(a), keep.hexdigest(), np.stack([a, b], 1).ravel()))
            yield batch(KEPT, *zip(*out, strict=True))

    return run


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end, start, end ... in bytes)."""
    if width < GRAM:
        raise ValueError(f"width {width} is under {GRAM}")
    body = F.coalesce(F.col(text_col), F.lit(""))
    sent = docs.select(body.alias("text")).mapInArrow(send_texts(width), "sha string, z binary")
    texts = sent.repartition(F.col("sha")).mapInArrow(once, "sha string, z binary")
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("id"), "sha", "z"), "texts")
    found = texts.select("id", "sha", "z").mapInArrow(send_anchors(width), ANCHOR_DDL).repartition(F.col("to")).sortWithinPartitions("key")
    found = materialize(found.mapInArrow(repeated_anchors(hot), REPEATED_DDL), "anchors")
    crowded = found.filter("id < 0").select("key", F.lit(True).alias("hot"))
    found = found.filter("id >= 0").join(crowded, "key", "left")
    of_text = found.groupBy("id").agg(F.collect_list(F.struct("at", "n", "key", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))  # at most a text's own
    contexts = texts.join(of_text, "id").select("id", "sha", "z", "found")  # the columns of the later join: one exchange serves both
    contexts = contexts.mapInArrow(send_contexts(width), CONTEXT_DDL)
    runs = contexts.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(match_windows(width), "id long, start long, n long")
    of_text = runs.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    cut = texts.join(of_text, "id").select("id", "sha", "z", "runs").mapInArrow(cut_texts(width), KEPT_DDL)
    members = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    several = members.groupBy("sha").agg((F.count(F.lit(1)) > 1).alias("several"))
    judged = materialize(several.join(cut, "sha", "left"), "judged")
    out = members.join(judged, "sha")
    whole = F.col("several") & (F.col("n_bytes") >= width)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL = {
    "op6_suffix_dedup": f"""
with n as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, h, unnest(range(0, length(h) // 2 - {WIDTH - 1})) as s from n where length(h) >= {2 * WIDTH}),
k as (select r, s, md5(substr(h, 2 * s + 1, {2 * WIDTH})) as m from w),
rep as (select r, s, lag(s) over (partition by r order by s) as before from k where m in (select m from k group by m having count(*) > 1)),
g as (select r, s, sum(case when before is null or s > before + {WIDTH} then 1 else 0 end) over (partition by r order by s) as run from rep),
span as (select r, run, min(s) as a, max(s) + {WIDTH} as b from g group by r, run),
gap as (select r, run, a, b, coalesce(lag(b) over (partition by r order by run), 0) as z from span),
cut as (select r, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by run) as body from gap join n using (r) group by r)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from n left join cut using (r)""",
}
