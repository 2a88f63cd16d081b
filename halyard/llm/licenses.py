"""License notices by fuzzy search.

A notice is a phrase of which some words name the license: those must occur unchanged, edits fall on the rest only, and no
edit puts a digit in, so another version or a neighbouring license isn't taken for it.  A notice of m characters with up to
e edits is cut into e + 1 pieces, of which one must occur unchanged.  The pieces are looked up in the words of a text,
joined by single spaces; around each the `regex` library matches the whole notice with bounded errors between word ends
and reports span and edits.  Places without an edit are the base places.

Null or wordless text has no words, no places and empty labels; notices never span two documents; texts are read whole;
repeated rows are judged each alone; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from halyard.llm.common import Words, table, text_blocks

#: Phrases whose unchanged places are counted, their labels, and the words that name the license.
BASE = (
    ("under the mit license", "mit", "mit"),
    ("apache license version 2", "apache-2", "apache 2"),
    ("cc by nc", "cc-by-nc", "cc by nc"),
)
#: Further notices that this operator knows, their labels, and the words that name the license.
MORE = (
    ("gnu general public license version 3", "gpl-3", "gnu general 3"),
    ("gnu lesser general public license", "lgpl", "gnu lesser"),
    ("mozilla public license version 2", "mpl-2", "mozilla 2"),
    ("redistribution and use in source and binary forms", "bsd", ""),
    ("permission is hereby granted free of charge", "mit", ""),
)


def edits_for(phrase: str) -> int:
    """One edit for about ten characters, three at most."""
    return min(3, max(1, len(phrase) // 10))


def pieces(phrase: bytes, n: int) -> list[tuple[int, bytes]]:
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Notice:
    def __init__(self, phrase: str, label: str, naming: str, base: bool, edits: int | None = None):
        self.phrase, self.label, self.base = phrase.encode(), label, base
        named, fuzzy, parts = set(naming.split()), [], []
        for word in phrase.split():  # what lies between naming words, spaces included, may have edits
            if word not in named:
                fuzzy.append(word)
                continue
            parts += [(" ".join(["", *fuzzy, ""] if parts else [*fuzzy, ""]), False)] * bool(fuzzy) or [(" ", None)] * bool(parts)
            parts.append((word, True))
            fuzzy = []
        if fuzzy:
            parts.append((" ".join(["", *fuzzy] if parts else fuzzy), False))
        room = edits_for(phrase) if edits is None else edits
        self.edits = room if any(kind is False for _, kind in parts) else 0
        self.seeds = pieces(self.phrase, self.edits + 1)
        shapes = {True: rb"(?<![^ \n])%s(?![^ \n])", None: b"%s", False: b"(?:%%s){e<=%d:[^0-9]}" % self.edits}
        body = b"".join(shapes[kind] % regex.escape(t.encode(), literal_spaces=True) for t, kind in parts)
        self.fuzzy = regex.compile(rb"(?b)(?<![^ \n])" + body + rb"(?![^ \n])")

    def places(self, text: bytes) -> list[tuple[int, int, int]]:
        """Start, end and edits of each place in words joined by spaces, documents ended by newlines."""
        size, exact, spans = len(self.phrase), set(), []
        at = text.find(self.phrase)
        while at >= 0:
            if text[at - 1 : at] in (b" ", b"\n", b"") and text[at + size : at + size + 1] in (b" ", b"\n", b""):
                exact.add(at)
            at = text.find(self.phrase, at + 1)
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                # the notice begins at most `edits` bytes from where the seed puts it; a byte more shows the word end
                lo, hi = max(0, at - offset - self.edits - 1), min(len(text), at - offset + size + self.edits + 1)
                # it holds the seed, so the newlines nearest to that bound it, whatever block its document stands in
                a, b = text.rfind(b"\n", lo, at), text.find(b"\n", at + len(seed), hi)
                spans.append((a + 1 if a >= 0 else lo, b if b >= 0 else hi))
                at = text.find(seed, at + 1)
        found = {(a, a + size): 0 for a in exact}
        for lo, hi in sorted(set(spans)):
            if (m := self.fuzzy.search(text, lo, hi)) and 0 < (k := sum(m.fuzzy_counts)) <= self.edits and text[m.start() - 1 : m.start()] in (b" ", b"\n", b"") and text[m.end() : m.end() + 1] in (b" ", b"\n", b""):
                found.setdefault((m.start(), m.end()), k)
        # of overlapping places the one with fewer edits stands; exact ones always do
        out: list[tuple[int, int, int]] = [(a, b, 0) for a, b in ((a, a + size) for a in sorted(exact))]
        for (a, b), k in sorted(found.items(), key=lambda x: (x[1], x[0])):
            if k and all(b <= s or a >= e for s, e, _ in out):
                out.append((a, b, k))
        return sorted(out)


def known(base: tuple = BASE, more: tuple = MORE) -> list[Notice]:
    return [Notice(*x, True) for x in base] + [Notice(*x, False) for x in more]


def joined(words: Words) -> tuple[bytes, np.ndarray]:
    """The block's words, each followed by a space or at its document's end a newline, and where each begins."""
    sizes = words.lengths + 1
    begins = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    where = np.repeat(words.starts - begins, sizes) + np.arange(total)
    out = np.append(words.lower, np.uint8(32))[where]
    out[begins + words.lengths] = 32
    last = words.first[1:][words.counts > 0] - 1
    out[(begins + words.lengths)[last]] = 10
    return out.tobytes(), begins


ARROW_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", ARROW_SPANS)])
OUT_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start_word: long, end_word: long, edits: long>>"


def scan(notices: list[Notice], data: np.ndarray, ends: np.ndarray) -> list[tuple]:
    words = Words(data, ends)
    n = words.counts.tolist()
    places: dict[int, list[tuple[int, int, int, Notice]]] = {}
    if len(words.starts):
        text, begins = joined(words)
        for notice in notices:
            for a, b, k in notice.places(text):
                w = int(np.searchsorted(begins, a, "right")) - 1
                e = int(np.searchsorted(begins, b - 1, "right"))
                d = int(words.doc[w])
                places.setdefault(d, []).append((w - int(words.first[d]), e - int(words.first[d]), k, notice))
    out = []
    for d, size in enumerate(n):
        found = sorted(places.get(d, ()), key=lambda x: x[:3])
        base = [x for x in found if x[3].base and not x[2]]
        labels = lambda some: ",".join(sorted({x[3].label for x in some}))
        score = max((1 - x[2] / len(x[3].phrase) for x in found), default=0.0)
        out.append((size, len(base), base[0][0] if base else None, base[-1][0] if base else None, labels(base), labels(found), score, [{"label": x[3].label, "start_word": x[0], "end_word": x[1], "edits": x[2]} for x in found]))
    return out


def kernel(base: tuple, more: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = known(base, more)
        for part, data, ends in text_blocks(batches, "text"):
            columns = list(zip(*scan(notices, data, ends), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(OUT)[1:], strict=True))], schema=OUT)

    return run


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, more: tuple = MORE) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(kernel(base, more), OUT_DDL)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLE_SQL: dict[str, str] = {}
