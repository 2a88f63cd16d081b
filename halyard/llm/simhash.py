"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints of 64 bits link at 3 or fewer differing bits, so of their 8 bytes at least 5 agree by position.  Any 5 of 8
positions hold a whole triple from one half, so an index of the 8 triples within the halves (24 bits each) brings every
linked pair together.  In a bucket the shared positional bytes of a pair are tallied, pairs below the guaranteed 5 are
dropped and the rest verified bit by bit.  Only distinct fingerprints are indexed, and a bucket gives the links of a
spanning forest, never its pairs, so groups of copies cost one row per distinct fingerprint and index entry.  Components
come from alternating large-star and small-star rounds on written tables.

Null and wordless texts have fingerprint zero and link like any other; texts shorter than a shingle are one shingle; texts
are read whole; repeated rows each get their row; a null id never is a smallest id; an empty table gives an empty result;
columns besides id and text are ignored, or by keep_one passed through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import LOWER_BYTE, MASKS, WRITTEN, clean_up, lanes, materialize, table, text_blocks

SHINGLE, SEED, BITS = 3, 42, 3
#: A bucket of more distinct fingerprints is split by two more bytes, in the same task.
BUCKET = 1 << 15

# XXH64's constants
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_same(view: np.ndarray, at: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the `size` bytes at each place.  view: lanes() of the bytes."""
    round_ = lambda acc, lane: rotl(acc + lane * P2, 31) * P1
    zero, done, seed = np.uint64(0), 0, np.uint64(seed)
    with np.errstate(over="ignore"):
        if size >= 32:
            v = [np.full(len(at), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while size - done >= 32:
                v = [round_(v[i], view[at + (done + 8 * i)]) for i in range(4)]
                done += 32
            h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for x in v:
                h = (h ^ round_(zero, x)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5, np.uint64)
        h = h + np.uint64(size)
        while size - done >= 8:
            h = rotl(h ^ round_(zero, view[at + done]), 27) * P1 + P4
            done += 8
        if done < size:
            rest = view[at + done]
            if size - done >= 4:
                h = rotl(h ^ ((rest & MASKS[4]) * P1), 23) * P2 + P3
                rest, done = rest >> np.uint64(32), done + 4
            while done < size:
                h = rotl(h ^ ((rest & MASKS[1]) * P5), 11) * P1
                rest, done = rest >> np.uint64(8), done + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    view, out = lanes(data), np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, 65535).astype(np.uint16), kind="stable")
    ordered = sizes[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for pick in np.split(order, cuts) if len(order) else ():
        n = int(sizes[pick[0]])
        if n < 512:
            out[pick] = xxh64_same(view, starts[pick], n)
        else:
            for i in pick.tolist():
                out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), SEED)
    return out


#: A byte's bits, lowest first, each as a byte of a word: words add up as eight counters.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]
SPACE = np.zeros(256, bool)
SPACE[0x20] = SPACE[0x09:0x0E] = True


def fingerprints(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each text of a block."""
    n_docs = len(ends) - 1
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, np.int8)
    if len(data):
        edge[1:-1] = inside[1:].astype(np.int8) - inside[:-1]
        edge[0], edge[-1] = inside[0], -int(inside[-1])
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.unique(ends[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    if len(cuts):
        starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    out = np.zeros(n_docs, np.uint64)
    if not len(starts):
        return out
    sizes = stops - starts + 1  # with the space behind
    begins = np.cumsum(sizes) - sizes
    text = LOWER_BYTE[np.append(data, np.uint8(32))[np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))]]
    text[begins + sizes - 1] = 32
    first = np.searchsorted(starts, ends)
    counts = np.diff(first)
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    head = np.cumsum(shingles) - shingles
    word = np.repeat(first[:-1] - head, shingles) + np.arange(int(shingles.sum()))
    last = word + np.repeat(np.minimum(counts, SHINGLE) - 1, shingles)
    h = xxh64(text, begins[word], begins[last] + sizes[last] - 1 - begins[word])
    # sums of at most 255 hashes of one document at a time don't overflow a byte
    some = np.flatnonzero(shingles)
    per = -(-shingles[some] // 255)
    group = np.repeat(np.arange(len(some)), per)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(per) - per, per)
    at = head[some][group] + 255 * nth
    of_doc = np.cumsum(per) - per
    raw = h.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        ones = np.add.reduceat(SPREAD[raw[:, j]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(ones, of_doc, axis=0)
        byte = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little")[:, 0]
        out[some] |= byte.astype(np.uint64) << np.uint64(8 * j)
    return out


def fingerprint_kernel(text_col: str, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_blocks(batches, text_col):
            names = [n for n in part.schema.names if n != text_col]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(fingerprints(data, ends).view(np.int64))], names=[*names, name])

    return run


def with_fingerprint(ids: DataFrame, text_col: str, name: str) -> DataFrame:
    """The columns of ids but its text, and the fingerprint as a signed long."""
    kept = [f for f in ids.schema.fields if f.name != text_col]
    return ids.mapInArrow(fingerprint_kernel(text_col, name), T.StructType([*kept, T.StructField(name, T.LongType())]))


#: The triples of byte positions within each half.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Of XORed fingerprints, how many of the 8 positional bytes agree."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that join all distinct fingerprints of a bucket that chains of close pairs join: at most one each."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            x = rest ^ a
            near = np.flatnonzero(shared_bytes(x) >= 8 - bits)
            near = near[np.bitwise_count(x[near]) <= bits]
            if len(near):
                out += [(int(a), int(b)) for b in rest[near]]
                queue += list(rest[near])
                rest = np.delete(rest, near)
    return out


def bucket_links(fps: np.ndarray, triple: tuple[int, ...]) -> list[tuple[int, int]]:
    if len(fps) <= BUCKET:
        return forest(fps)
    out = []
    for pair in combinations([j for j in range(8) if j not in triple], 2):
        key = (fps >> np.uint64(8 * pair[0]) & MASKS[1]) << np.uint64(8) | (fps >> np.uint64(8 * pair[1]) & MASKS[1])
        order = np.argsort(key, kind="stable")
        for part in np.split(fps[order], np.flatnonzero(np.diff(key[order])) + 1):
            out += forest(part)
    return out


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def links_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) in order of both, all rows of a key in one task: its links.  A bucket is held, and a batch."""

    def judged(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        stops = np.append(first[1:], len(key))
        size = stops - first
        two = first[size == 2]
        x = fp[two] ^ fp[two + 1]
        two = two[(shared_bytes(x) >= 8 - BITS) & (np.bitwise_count(x) <= BITS)]
        pairs = np.stack([fp[two], fp[two + 1]], 1)
        more = [p for a, b in zip(first[size > 2].tolist(), stops[size > 2].tolist(), strict=True) for p in bucket_links(fp[a:b], TRIPLES[int(key[a]) >> 24])]
        pairs = np.concatenate([pairs, np.array(more, np.uint64).reshape(-1, 2)]).view(np.int64)
        pairs = np.unique(np.stack([pairs.min(1), pairs.max(1)], 1), axis=0) if len(pairs) else pairs
        for at in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[at : at + 100_000, i])) for i in (0, 1)], schema=LINKS)

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        parts.append((key, fp))
        if key[-1] == parts[0][0][0]:  # one bucket up to now
            continue
        key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        done = int(np.searchsorted(key, key[-1]))  # the last key may go on
        yield from judged(key[:done], fp[:done])
        parts = [(key[done:], fp[done:])]
    if parts:
        yield from judged(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): links that connect what chains of close fingerprints connect.  distinct: a column fp without repeats."""
    byte = lambda j: F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(i << 24).cast("long") + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(TRIPLES)])
    entries = distinct.select(F.explode(keys).alias("key"), "fp")
    return entries.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(links_kernel, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v), root being the component's least node.

    Large-star and small-star in turn: each node's neighbours are hung on the least of them.  Rounds grow with the
    logarithm of the longest chain.  Least neighbours are pre-aggregated and written, so that the join back is one of two
    exchanges and a hub's part of it can be split.  Of the rounds' tables only the last stays.
    """
    spark, first = edges.sparkSession, len(WRITTEN)
    edges, seen = materialize(edges.distinct(), "links"), None
    while True:
        # large-star
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = materialize(big.filter("u != v").distinct(), "large-stars")
        # small-star: edges (u, v) run from larger to smaller now
        least = materialize(big.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = big.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").filter("u != v").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        clean_up(spark, first, (WRITTEN[-1],))
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicate_classes(prints: DataFrame) -> DataFrame:
    """fp -> component_id, the smallest doc_id reachable, and root, which names the component where ids are null or repeated.
    prints: doc_id, fp."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    ids = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    prints = materialize(with_fingerprint(ids, "text", "fp"), "prints")
    classes = near_duplicate_classes(prints)
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest id; columns unchanged.

    Of repeated rows that share that id the one of the least content hash stays; of wholly equal ones, one: where there
    are such, each task folds its own before they meet, so a row that a third of the table repeats is one row a task.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), F.col(text_col).alias("text"))
    prints = materialize(with_fingerprint(ids, "text", "fp"), "prints")
    equal = prints.groupBy("fp", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    classes = near_duplicate_classes(prints.select("doc_id", "fp"))
    best = equal.join(classes, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("best"))
    best = materialize(best.select(F.coalesce("best.doc_id", F.lit(0)).alias("_halyard_id"), F.col("best.row").alias("_halyard_row"), F.col("best.n").alias("n")), "kept")
    key, columns = ["_halyard_id", "_halyard_row"], [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_halyard_id"), row.alias("_halyard_row"))
    chosen = marked.join(best.filter("n = 1").select(*key), key, "left_semi").select(*columns)
    several = best.filter("n > 1").select(*key)
    if several.isEmpty():
        return chosen
    folded = marked.join(several, key, "left_semi").groupBy(*key).agg(F.first(F.struct(*columns)).alias("_halyard_all"))
    return chosen.unionByName(folded.select("_halyard_all.*"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
