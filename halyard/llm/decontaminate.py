"""Benchmark decontamination by suffix arrays.

Documents are shards of a few MB.  A shard's suffix array orders its word suffixes by their first 13 words; suffixes that
share no opening trigram (or shorter whole item) with the benchmark can match nothing and are left out before sorting.
Every suffix of every benchmark item that is long enough and opens like one of the shard's is binary-searched in it, which
gives all places of each window, the longest verbatim match and where it lies.  Nothing is shuffled: a shard needs only
the benchmark.  That is shipped in blocks of a stated size; with more than one, each has a pass over the documents of its
own, and what the passes before found is written in between.

Items are cut into pieces of a stated number of words that overlap by a window less a word, so no window is lost, however
long an item, and a block holds pieces, so equal or long items don't fill one; the longest match is told within a piece.

Null or wordless text has no words and no hits; a null item id counts hits but is no item; repeated rows are judged each
alone, repeated items count once; an empty benchmark hits nothing; an empty table gives an empty result; all columns of
docs pass through unread, but what is found takes the place of one of that name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import LOWER, M1, M2, M3, UPPER, Words, fresh, materialize, mix, string_parts, table, text_blocks

WINDOW = 13
#: Benchmark text shipped to the executors at once; there it takes some 6 times as much.
ITEM_BYTES = 16 << 20
#: Words of a piece of an item at most.
PIECE = 1 << 17
#: A document is contaminated when at least one word in so many is hit.
RATIO = 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.LongType())),  # start, end, start, end ... in words, disjoint and ascending
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()),
    T.StructField("longest_at", T.LongType()),
    T.StructField("longest_item", T.StringType()),
])
ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])


def opening(words: list[np.ndarray]) -> np.ndarray:
    """A hash of one to three words in a row, each given as an array."""
    out = words[0] * M1
    for w, m in zip(words[1:], (M2, M3), strict=False):
        out = out + mix(w) * m
    return mix(out)


def openings(h: np.ndarray, n: int) -> np.ndarray:
    """Of each suffix that has n words or more, the first n."""
    return opening([h[j : len(h) - n + 1 + j] for j in range(n)]) if len(h) >= n else np.zeros(0, np.uint64)


class Items:
    """A block of the benchmark: its windows by length, and the openings that a suffix must have to match any."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        data, ends = string_parts(pa.array(texts, pa.string()))
        words = Words(data, ends)
        h = words.hashes()
        self.ids, self.window, self.words = ids, window, h
        self.queries: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # length, word, item, start, opening
        self.openings: dict[int, np.ndarray] = {}
        size = np.minimum(words.counts, window)
        for n in np.unique(size[size > 0]).tolist():
            items = np.flatnonzero(size == n)
            spans = np.where(n == window, words.counts[items] - window + 1, 1)
            item = np.repeat(items, spans)
            start = np.arange(len(item)) - np.repeat(np.cumsum(spans) - spans, spans)
            word = words.first[item] + start
            k = min(n, 3)
            head = opening([h[word + j] for j in range(k)])
            self.queries.append((n, word, item.astype(np.int32), start.astype(np.int32), head))
            heads = np.unique(head)
            self.openings[k] = np.union1d(self.openings.get(k, heads), heads)
        self.sieve = {}
        for k, heads in self.openings.items():
            bits = np.zeros(1 << 20, bool)
            bits[heads >> np.uint64(44)] = True
            self.sieve[k] = bits

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Suffixes that open like a window, and by number of words the openings that occur."""
        found, seen = [np.zeros(0, np.int64)], {}
        for k, heads in self.openings.items():
            o = openings(h, k)
            at = np.flatnonzero(self.sieve[k][o >> np.uint64(44)])
            near = np.searchsorted(heads, o[at])
            at = at[heads[np.minimum(near, len(heads) - 1)] == o[at]]
            found.append(at)
            seen[k] = np.unique(o[at])
        return np.unique(np.concatenate(found)), seen

    def places(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word position, length, item and item start of every occurrence of every window."""
        at, seen = self.candidates(h)
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none, none
        depth, stop = self.window, words.first[words.doc[at] + 1]
        where = at[:, None] + np.arange(depth)
        keys = np.where(where < stop[:, None], h[np.minimum(where, len(h) - 1)], 0).astype(">u8")
        keys = np.ascontiguousarray(keys).view(f"S{8 * depth}")[:, 0]
        order = np.argsort(keys, kind="stable")
        suffixes = keys[order]
        out = []
        for n, word, item, start, head in self.queries:
            heads = seen[min(n, 3)]
            if not len(heads):
                continue
            here = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, head), len(heads) - 1)] == head)
            item, start = item[here], start[here]
            rows = self.words[word[here][:, None] + np.arange(n)]
            low = np.zeros((len(rows), depth), ">u8")
            low[:, :n] = rows
            high = np.full((len(rows), depth), 0xFFFFFFFFFFFFFFFF, ">u8")
            high[:, :n] = rows
            lo = np.searchsorted(suffixes, low.view(f"S{8 * depth}")[:, 0], "left")
            hi = np.searchsorted(suffixes, high.view(f"S{8 * depth}")[:, 0], "right")
            n_each = np.maximum(hi - lo, 0)
            q = np.repeat(np.arange(len(rows)), n_each)
            place = order[lo[q] + np.arange(len(q)) - np.repeat(np.cumsum(n_each) - n_each, n_each)]
            p = at[place]
            fits = p + n <= stop[place]
            out.append((p[fits], np.full(int(fits.sum()), n), item[q[fits]], start[q[fits]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none,) * 4

    def longest(self, words: Words, p: np.ndarray, n: np.ndarray, item: np.ndarray, start: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Of each document that is hit: words, position and item of its longest verbatim match, first of equals."""
        order = np.lexsort((p, p - start, item))
        p, n, item, start = p[order], n[order], item[order], start[order]
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        length = p[last] + n[last] - p[first]
        out: dict[int, tuple[int, int, int]] = {}
        for d, l, a, i in zip(words.doc[p[first]].tolist(), length.tolist(), p[first].tolist(), item[first].tolist(), strict=True):
            a -= int(words.first[d])
            if d not in out or (-l, a, i) < (-out[d][0], out[d][1], out[d][2]):
                out[d] = (l, a, i)
        return out

    def judge(self, data: np.ndarray, ends: np.ndarray) -> list[dict]:
        words = Words(data, ends)
        h = words.hashes()
        out = [{"n_words": n, "hits": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None} for n in words.counts.tolist()]
        p, n, item, start = self.places(words, h)
        if not len(p):
            return out
        depth = np.zeros(len(h) + 1, np.int64)
        np.add.at(depth, p, 1)
        np.add.at(depth, p + n, -1)
        hit = np.cumsum(depth[:-1]) > 0
        first = np.zeros(len(h) + 1, bool)
        first[words.first[:-1]] = True
        edge = np.ones(len(h), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | first[1 : len(h)]
        runs = np.flatnonzero(edge)
        for a, b in zip(runs.tolist(), np.append(runs[1:], len(h)).tolist(), strict=True):
            if hit[a]:
                d = int(words.doc[a])
                out[d]["hits"] += [a - int(words.first[d]), b - int(words.first[d])]
        for d, i in np.unique(np.stack([words.doc[p], item], 1), axis=0).tolist():
            if self.ids[i] is not None:
                out[d]["items"].append(self.ids[i])
        for d, (l, a, i) in self.longest(words, p, n, item, start).items():
            out[d] |= {"longest": l, "longest_at": a, "longest_item": self.ids[i]}
        return out


def merged(a: dict, b: dict) -> dict:
    """What two blocks of the benchmark found in one document."""
    spans = sorted([(a["hits"][i], a["hits"][i + 1]) for i in range(0, len(a["hits"]), 2)] + [(b["hits"][i], b["hits"][i + 1]) for i in range(0, len(b["hits"]), 2)])
    hits: list[int] = []
    for s, e in spans:
        if hits and s <= hits[-1]:
            hits[-1] = max(hits[-1], e)
        else:
            hits += [s, e]
    best = b if b["longest"] > a["longest"] else a
    return best | {"hits": hits, "items": a["items"] + b["items"]}


def kernel(ids: list[str | None], texts: list[str | None], window: int, text_col: str, found: str, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the column `found`, or if this isn't the first block adds to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, window)
        for part, data, ends in text_blocks(batches, text_col):
            rows, names, columns = items.judge(data, ends), part.schema.names, list(part.columns)
            if first:
                names, columns = [*names, found], [*columns, pa.array(rows, ARROW_FOUND)]
            else:
                rows = [merged(a, b) for a, b in zip(part.column(names.index(found)).to_pylist(), rows, strict=True)]
                columns[names.index(found)] = pa.array(rows, ARROW_FOUND)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(window: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, text): items cut into pieces of `size` words and as many more as a window begun in them needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_blocks(batches, "text"):
            words, out = Words(data, ends), []
            for d, (i, n) in enumerate(zip(part.column(part.schema.get_field_index("id")).to_pylist(), words.counts.tolist(), strict=True)):
                first = int(words.first[d])
                for k in range(0, max(1, n - window + 1) if n else 0, size):
                    a, b = first + k, first + min(n, k + size + window - 1) - 1
                    out.append((i, data[words.starts[a] : words.starts[b] + words.lengths[b]].tobytes().decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["id", "text"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, item_bytes: int = ITEM_BYTES, piece: int = PIECE, found: str = "_found") -> DataFrame:
    """docs with a struct column `found`: words, hit spans, items, the longest verbatim match."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    items = materialize(items.mapInArrow(pieces(window, piece), "id string, text string").distinct(), "items")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = -(-2 * size // item_bytes) if size > item_bytes else 1  # half full as a rule, as pieces are dealt by hash
    out = docs.drop(*[c for c in docs.columns if c.lower() == found.lower()])
    schema = T.StructType([*out.schema.fields, T.StructField(found, FOUND)])
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # a block
        if b:
            out = materialize(out, "contamination")
        out = out.mapInArrow(kernel([r["id"] for r in rows], [r["text"] for r in rows], window, text_col, found, not b), schema)
    return out


def n_hit(found: str = "_found") -> Column:
    return F.aggregate(F.transform(f"{found}.hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(found: str = "_found", ratio: int = RATIO) -> Column:
    return (n_hit(found) > 0) & (n_hit(found) * ratio >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """docs without those that benchmark passages make up enough of; columns unchanged."""
    name = fresh(docs.columns, "_halyard_found")
    found = find_contamination(docs, benchmark, found=name, **options)
    return found.filter(~contaminated(name)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    items = F.array_sort(F.array_distinct("_found.items"))
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


QUERIES = {"op2_decontaminate": op2_decontaminate}
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op2_decontaminate": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
p as (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) as i from b where len(w) > 0),
win as (select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i : i + {WINDOW - 1}], ' ') as body from p),
sizes as (select distinct n from win),
g as (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
hit as (select g.r, g.i, g.n, win.item_id from g join win on g.n = win.n and array_to_string(g.w[g.i : g.i + g.n - 1], ' ') = win.body),
covered as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hit) group by r),
items as (select r, count(distinct item_id::varchar) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and {RATIO} * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join covered on covered.r = d.r left join items on items.r = d.r""",
}
