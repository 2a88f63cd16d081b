"""Best-fit packing with exact-complement hashing.

Tokens come from a fixed public tokenizer and end with id 0; only what is longer than a sequence is cut.  The packer sees
the histogram of piece lengths, a table of `size` rows at most however many pieces there are.  For each length, longest
first, it looks up a single length, then a pair, then a triple that exactly fills the gap, and uses each combination
as often as counts allow; what no combination fills goes best-fit, longest first.  The plan says how many sequences hold
which lengths; pieces are numbered within their length and find their place in the plan by that rank, without a shuffle
of texts or tokens.

Null text counts as empty and is the piece [0]; pieces of repeated rows are packed each; a null id stays null; texts are
tokenized whole; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import LOWER_BYTE, MASKS, lanes, materialize, slice_hashes, table, text_blocks

SIZE = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 600_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary; a space stays one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(other)} | {32: " "}


SPACE_BYTE, ALNUM_BYTE, LETTER_BYTE, PUNCT_BYTE = (np.zeros(256, bool) for _ in range(4))
SPACE_BYTE[[0x20, 0x0A]] = True
LETTER_BYTE[0x61:0x7B] = True
ALNUM_BYTE[0x30:0x3A] = ALNUM_BYTE[0x61:0x7B] = True
PUNCT_BYTE[list(string.punctuation.encode())] = True


class SlotTable:
    """Open addressing over arrays: the hash and first bytes of a chunk, and its number.  Looks up many at once."""

    def __init__(self, limit: int):
        self.mask = (1 << (2 * limit - 1).bit_length()) - 1
        self.hash, self.head = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.number = np.full(self.mask + 1, -1, np.int32)

    def find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The numbers of chunks, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            at = slot if len(left) == len(h) else slot[left]
            held = self.hash[at]
            hit = (held == h[left]) & (self.head[at] == head[left])
            out[left[hit]] = self.number[at[hit]]
            left = left[~hit & (held != 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, head: np.ndarray, number: np.ndarray) -> None:
        """Chunks of different hashes, none of them known."""
        left, slot = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            at = slot[left]
            free = self.hash[at] == 0
            self.hash[at[free]] = h[left[free]]  # of several for one slot the last stays
            mine = free & (self.hash[at] == h[left])
            self.head[at[mine]], self.number[at[mine]] = head[left[mine]], number[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & self.mask


class WordCache:
    """Ids of texts, chunk by chunk.

    A pre-token of this tokenizer holds no white space and ends where a letter or digit meets punctuation, so texts can
    be cut there and chunks encoded alone, each once.  Words of plain lower-case letters are already normalised and are
    one pre-token each; they go in bulk to the same merges without the normaliser and the pre-token pattern.  Everything
    else goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.alphabet = byte_alphabet()
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.last[[i for w, i in model["vocab"].items() if w.endswith(model["end_of_word_suffix"])]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.slots, self.known = SlotTable(self.limit), 0
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)  # of a chunk's ids in the pool
        self.pool, self.used = np.zeros(4096, "<u4"), 0

    def alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, chunk: bytes) -> bytes | None:
        """A word of letters as the normaliser would leave it, if that is sure: letters below U+0250 are lower-cased one
        by one, and all but one into one letter each."""
        s = chunk.decode("utf-8", "replace")
        if not s.isalpha() or max(s) >= "\u0250" or "\u0130" in s or not unicodedata.is_normalized("NFC", s):
            return None
        return s.lower().encode()

    def encoded(self, chunks: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks, one after the other, and how many each has.  letters: whether it is a-z only."""
        normal = [c if l else self.plain(c) for c, l in zip(chunks, letters.tolist(), strict=True)]
        words, rest = [i for i, n in enumerate(normal) if n], [i for i, n in enumerate(normal) if not n]
        count, parts = np.zeros(len(chunks), np.int64), []  # parts: chunks and all their ids
        groups = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        texts = [b" ".join([normal[i] for i in g]).decode("latin-1").translate(self.alphabet) for g in groups]
        for g, text in zip(groups, texts, strict=True):
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) == len(g):
                count[g] = np.diff(stops, prepend=0)
                parts.append((g, ids))
            else:
                rest += g
        for at in range(0, len(rest), 1000):
            g = rest[at : at + 1000]
            ids = self.alone([chunks[i].decode("utf-8", "replace") for i in g])
            count[g] = [len(x) for x in ids]
            parts.append((g, np.concatenate(ids)))
        order = np.array([i for g, _ in parts for i in g], np.int64)
        ids = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, "<u4")
        first = np.zeros(len(chunks), np.int64)
        first[order] = np.cumsum(count[order]) - count[order]
        return spread(ids, first, count), count

    def learn(self, chunks: list[bytes], letters: np.ndarray, h: np.ndarray, head: np.ndarray) -> None:
        ids, count = self.encoded(chunks, letters)
        n, m = self.known + len(chunks), self.used + len(ids)
        while n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.first[self.known : n], self.count[self.known : n] = self.used + np.cumsum(count) - count, count
        self.pool[self.used : m] = ids
        self.slots.add(h, head, np.arange(self.known, n, dtype=np.int32))
        self.known, self.used = n, m

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, one text after the other, and how many each has."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self.encode_special(raw, ends)
        lower = LOWER_BYTE[data]
        space = SPACE_BYTE[lower]
        cut = np.ones(len(lower), bool)  # where a chunk may begin
        cut[1:] = space[:-1] | (ALNUM_BYTE[lower[:-1]] & PUNCT_BYTE[lower[1:]])
        cut[ends[:-1][ends[:-1] < len(lower)]] = True
        start = np.flatnonzero(cut & ~space)
        stop = np.append(start[1:], len(lower))
        # white space behind a chunk isn't part of it
        gap = np.append(np.flatnonzero(space), len(lower))
        if len(start):
            stop = np.minimum(stop, gap[np.searchsorted(gap, start)])
        size = stop - start
        view = lanes(lower)
        h = slice_hashes(view, start, size) | np.uint64(1)
        head = view[start] & MASKS[np.minimum(size, 8)]
        number = self.slots.find(h, head)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, pick = np.unique(h[new], return_index=True)
            if self.known + len(pick) > self.limit:
                self.forget()
                new = np.arange(len(h))
                _, pick = np.unique(h, return_index=True)
            if len(pick) > self.limit:
                return self.encode_direct(raw, ends)
            pick = new[pick]
            low, a, b = lower.tobytes(), start[pick], stop[pick]
            letter = np.concatenate([[0], np.cumsum(LETTER_BYTE[lower])])
            self.learn([low[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], letter[b] - letter[a] == b - a, h[pick], head[pick])
            number[new] = self.slots.find(h[new], head[new])
            if (number < 0).any():  # two chunks of one hash
                return self.encode_direct(raw, ends)
        count = self.count[number]
        total = np.concatenate([[0], np.cumsum(count)])
        where = total[np.searchsorted(start, ends)]
        return spread(self.pool, self.first[number], count), np.diff(where)

    def encode_direct(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ends.tolist()
        ids = [self.alone([raw[a:b].decode("utf-8", "replace")])[0] for a, b in zip(at, at[1:], strict=False)]
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.array([len(x) for x in ids], np.int64)

    def encode_special(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with a special token's string go whole: cutting or lower-casing could break one or make one."""
        out = []
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            text = raw[a:b]
            if any(s in text for s in self.special):
                out.append(self.alone([text.decode("utf-8", "replace")])[0])
            else:
                out.append(self.encode(np.frombuffer(text, np.uint8), np.array([0, b - a]))[0])
        return np.concatenate(out) if out else np.zeros(0, "<u4"), np.array([len(x) for x in out], np.int64)


def spread(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at `first`, one after the other."""
    total = np.cumsum(count)
    where = np.repeat(first - (total - count), count)
    where += np.arange(len(where))
    return pool[where]


CACHES: dict[str, WordCache] = {}


def cache_for(name: str) -> WordCache:
    if name not in CACHES:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        CACHES[name] = WordCache(name if os.path.exists(name) else public_tokenizers.path(name))
    return CACHES[name]


OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])
OUT_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def kernel(name: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces, numbered within their partition and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = cache_for(name), np.zeros(size + 1, np.int64)
        for rows, data, ends in text_blocks(batches, "text"):
            ids, count = cache.encode(data, ends)
            raw, at = ids.astype("<u4").tobytes(), 0
            out: list[tuple] = []
            for d, n in zip(rows.column(0).to_pylist(), count.tolist(), strict=True):
                body, at = raw[4 * at : 4 * (at + n)] + b"\0\0\0\0", at + n
                for k, s in enumerate(range(0, n + 1, size)):
                    length = min(size, n + 1 - s)
                    out.append((d, k, s, length, zlib.crc32(body[4 * s : 4 * (s + length)]), int(seen[length])))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    return run


Plan = list[tuple[tuple[int, ...], int]]  # lengths of a sequence's pieces, and how many such sequences


class Sums:
    """What fills a gap exactly, by hashing sums: the index has the gap's single, its pair and its triple of lengths, each
    found when it is first asked for and checked against the counts when used.  Counts only fall, so a sum that nothing
    makes is settled for good."""

    def __init__(self, have: np.ndarray):
        self.have = have
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}

    def free(self, parts: tuple[int, ...]) -> bool:
        return all(self.have[p] >= parts.count(p) for p in parts)

    def search(self, total: int, but: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """Two lengths of that sum beside `but`, the most even ones: short pieces fill later gaps."""
        if total < 2:
            return None
        left = self.have[:total]
        if but:
            left = left.copy()
            for p in but:
                if p < total:
                    left[p] -= 1
        a = np.arange((total + 1) // 2, total)
        fits = (left[a] > 0) & (left[total - a] > (2 * a == total))
        return (int(a[k]), total - int(a[k])) if fits[k := int(np.argmax(fits))] else None

    def pair(self, total: int, but: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        found = self.pairs.get(total, ())
        if found is not None and not (found and self.free(found)):
            found = self.pairs[total] = self.search(total)
        if found is None or not but or self.free((*found, *but)):
            return found
        return self.search(total, but)

    def triple(self, total: int) -> tuple[int, ...] | None:
        found = self.triples.get(total, ())
        if found is None or (found and self.free(found)):
            return found
        found = None
        for a in np.flatnonzero(self.have[: max(0, total - 1)])[::-1].tolist():
            if 3 * a < total:
                break
            if two := self.pair(total - a, (a,)):
                found = (a, *two)
                break
        self.triples[total] = found
        return found

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if gap <= 0:
            return None
        return (gap,) if self.have[gap] else self.pair(gap) or self.triple(gap)


def pack(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Sequences that hold all pieces; the number of distinct ones depends on `size`, not on the counts."""
    have = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    plan: Plan = []
    if have[size]:
        plan.append(((size,), int(have[size])))
        have[size] = 0
    sums = Sums(have)
    for length in range(size - 1, 0, -1):  # what is left of a longer one is in no exact sum any more
        while have[length]:
            have[length] -= 1
            fill = sums.fill(size - length)
            have[length] += 1
            if fill is None:
                break
            parts = (length, *fill)
            n = min(int(have[p]) // parts.count(p) for p in parts)
            for p in parts:
                have[p] -= n
            plan.append((parts, n))
    room: dict[int, list[list]] = {}  # gap -> sequences with that gap
    gaps = np.zeros(size + 1, bool)

    def put(parts: tuple[int, ...], n: int) -> None:
        gap = size - sum(parts)
        room.setdefault(gap, []).append([parts, n])
        gaps[gap] = True

    for length in range(size - 1, 0, -1):
        left = int(have[length])
        while left:
            gap = length + int(np.argmax(gaps[length:]))
            if not gaps[gap]:
                each = min(left, size // length)
                put((length,) * each, left // each)
                left %= each
                continue
            parts, n = room[gap].pop()
            gaps[gap] = bool(room[gap])
            used = min(n, left)
            left -= used
            if n > used:
                put(parts, n - used)
            put((*parts, length), used)
    return plan + [(tuple(p), n) for some in room.values() for p, n in some]


def places(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """length << 40 | first rank, that rank, sequence and offset of each run of pieces, sorted: the piece of rank r lies
    r - first rank sequences further."""
    rows, taken, sequence = [], {}, 0
    for parts, n in plan:
        offset = 0
        for p in parts:
            first = taken.get(p, 0)
            rows.append(((p << 40) | first, first, sequence, offset))
            taken[p] = first + n
            offset += p
        sequence += n
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    texts = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    pieces = texts.mapInArrow(kernel(tokenizer, size), OUT_DDL).withColumn("part", F.spark_partition_id())
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    keys, ranks, sequences, offsets = places(pack(histogram, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            more = [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *more], names=[*b.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
