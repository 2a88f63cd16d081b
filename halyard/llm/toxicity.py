"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and their first four and five bytes, each as a 64-bit hash; a term counts once.  Over the
terms of the labelled sample, all of them, a factorization machine has a weight for each and, by factors, one for each
pair, so that two terms can say more together than their sum, or the opposite of it.  Both are sparse: a weight stays zero
unless the term splits the classes better than hardly any would with shuffled labels; factors stay zero unless the
term belongs to an interaction that what the weights leave over shows, and that chance, measured with that remainder
shuffled, doesn't.  Interactions are looked for among all pairs of all terms at once, as leading vectors of the pairs'
gradient, so terms that mean nothing alone are found; they count if a fifth of the sample that they weren't learnt from
is told apart better with them.  The whole text is scored.

The sample is bounded: at most `sample` labelled ids, those of least hash, none of them held out, and of those at most
`sample_bytes` of text.  Everything else runs over all rows.  Rows of null id or null label teach nothing; an id with
several labels is toxic if one says so, one with several texts teaches the least; null and wordless texts get the score
of no term; with only one class every text gets the smoothed base rate,
without labels a third, so nothing is rejected; repeated rows are scored each; an
empty table gives an empty result; other columns pass through unread, but the score takes the place of one of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.llm.common import M1, Words, fresh, lanes, materialize, mix, slice_hashes, table, text_blocks

#: Labelled ids to learn from at most, bytes of their texts at most, and factors.
SAMPLE, SAMPLE_BYTES, FACTORS = 10_000, 20 << 20, 6
#: Of the terms that get weights, the share that shuffled labels would give too; and how far an interaction must stand out
#: above shuffled remainders.
BY_CHANCE, STANDS_OUT = 0.01, 1.3
#: Where the loss on unseen rows is below this, weights tell the classes apart and no interactions are looked for.
SETTLED = 0.01
#: Added to how many texts a term is in, when interactions are looked for.
RARE = 50
SKETCH = 2
PREFIXES = (4, 5)
#: Out of so many parts of all ids, part 0 is held out.
FOLDS = 5


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def terms(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every term, repeats included."""
    words = Words(data, ends)
    view = lanes(words.lower)
    doc, out = [words.doc], [slice_hashes(view, words.starts, words.lengths)]
    for n in PREFIXES:
        at = np.flatnonzero(words.lengths > n)
        out.append(mix(slice_hashes(view, words.starts[at], np.full(len(at), n)) ^ np.uint64(n)))
        doc.append(words.doc[at])
    return np.concatenate(doc), np.concatenate(out)


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[new], term[new]


def sketch_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): these and SKETCH least hashes of neighbouring words, which copies with few edits mostly share."""
    for part, data, ends in text_blocks(batches, "text"):
        words = Words(data, ends)
        h, some = slice_hashes(lanes(words.lower), words.starts, words.lengths), np.flatnonzero(words.counts)
        after = np.append(h[1:], np.uint64(0))
        after[words.first[1:][some] - 1] = 0
        marks = []
        for k in range(SKETCH):
            mark = np.zeros(part.num_rows, np.uint64)
            if len(some):
                mark[some] = np.minimum.reduceat(mix(h * M1 + mix(after ^ np.uint64(k + 1))), words.first[:-1][some])
            marks.append(pa.array(mark.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*part.columns, *marks], names=[*part.schema.names, *(f"m{k}" for k in range(SKETCH))])


def term_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): toxic and the text's distinct terms."""
    for part, data, ends in text_blocks(batches, "text"):
        doc, term = distinct(*terms(data, ends))
        cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(term.view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("toxic")), lists], names=["toxic", "terms"])


@dataclass
class Model:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def find(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and number of each of the model's terms that occur, without repeats."""
        doc, term = terms(data, ends)
        if not len(self.terms):
            return doc[:0], doc[:0]
        sieve = np.zeros(1 << 16, bool)
        sieve[self.terms >> np.uint64(48)] = True
        keep = np.flatnonzero(sieve[term >> np.uint64(48)])
        doc, term = doc[keep], term[keep]
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        pair = np.unique(doc[hit].astype(np.int64) * len(self.terms) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)

    def raw(self, n: int, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of factors."""
        sums = np.stack([np.bincount(doc, self.factors[term, f], n) for f in range(self.factors.shape[1])], 1)
        squares = np.bincount(doc, (self.factors[term] ** 2).sum(1), n)
        return self.bias + np.bincount(doc, self.weights[term], n) + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(len(ends) - 1, *self.find(data, ends))[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Sample:
    """Labelled texts by their terms, which are numbered; doc ascending."""

    vocabulary: np.ndarray  # sorted hashes
    doc: np.ndarray
    term: np.ndarray
    label: np.ndarray

    def rows(self, which: np.ndarray) -> Sample:
        keep, place = which[self.doc], np.cumsum(which, dtype=np.int32) - 1
        return Sample(self.vocabulary, place[self.doc[keep]], self.term[keep], self.label[which])

    def of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and place among the chosen terms, sorted numbers, of each that occurs."""
        place = np.full(len(self.vocabulary), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        at = place[self.term]
        found = np.flatnonzero(at >= 0)
        return self.doc[found].astype(np.int64), at[found].astype(np.int64)


def evidence(sample: Sample, label: np.ndarray) -> np.ndarray:
    """The likelihood-ratio statistic of each term's split between the classes."""
    size = len(sample.vocabulary)
    n, yes = np.bincount(sample.term, minlength=size), np.bincount(sample.term, label[sample.doc], size)
    base = label.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, share: np.where(k > 0, k * np.log(k / (n * share)), 0.0)
        return 2 * (part(yes, base) + part(n - yes, 1 - base))


def telling(sample: Sample, shuffles: int = 5) -> np.ndarray:
    """Terms that split the classes, as many as keep those that shuffled labels would give to a small share."""
    found, rng = evidence(sample, sample.label), np.random.default_rng(13)
    chance = np.sort(np.concatenate([evidence(sample, rng.permutation(sample.label)) for _ in range(shuffles)]))
    order = np.argsort(-found, kind="stable")
    false = (len(chance) - np.searchsorted(chance, found[order])) / shuffles
    good = np.flatnonzero(false <= BY_CHANCE * np.arange(1, len(order) + 1))
    return np.sort(order[: good[-1] + 1]) if len(good) else order[:0]


class PairGradient:
    """What a remainder says about pairs of terms: the symmetric matrix of each pair's gradient, terms scaled by how often
    they occur, known by its products with vectors only.  Rare terms are scaled less, as few texts say little of a pair."""

    def __init__(self, sample: Sample, rest: np.ndarray):
        self.sample, self.rest = sample, rest
        n = np.bincount(sample.term, minlength=len(sample.vocabulary))
        self.scale = 1 / np.sqrt(n + RARE)
        self.own = np.bincount(sample.term, rest[sample.doc], len(n)) * self.scale**2

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        s = self.sample
        sums = np.bincount(s.doc, (self.scale * v)[s.term], len(s.label))
        return self.scale * np.bincount(s.term, (self.rest * sums)[s.doc], len(v)) - self.own * v

    def leading(self, steps: int = 14) -> tuple[float, np.ndarray]:
        """The largest eigenvalue and its vector, by Lanczos steps."""
        size = len(self.scale)
        q = np.random.default_rng(3).normal(size=size)
        basis, alpha, beta = [q / np.linalg.norm(q)], [], []
        for _ in range(min(steps, size)):
            w = self @ basis[-1]
            alpha.append(float(w @ basis[-1]))
            for u in basis:
                w = w - (w @ u) * u
            norm = float(np.linalg.norm(w))
            if norm < 1e-9:
                break
            beta.append(norm)
            basis.append(w / norm)
        k = len(alpha)
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
        return float(values[-1]), np.sum([c * u for c, u in zip(vectors[:, -1], basis, strict=False)], 0)


def interacting(sample: Sample, rest: np.ndarray, shuffles: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the strongest interaction that the remainder shows and shuffled ones don't, and their sides in it."""
    none = np.zeros(0, np.int64), np.zeros(0)
    if not len(sample.vocabulary):
        return none
    value, vector = PairGradient(sample, rest).leading()
    rng, chance, level = np.random.default_rng(11), 0.0, 0.0
    for _ in range(shuffles):
        shuffled = PairGradient(sample, rng.permutation(rest))
        chance = max(chance, shuffled.leading()[0])
        level = max(level, float(np.abs(shuffled @ vector).max()))
    if value <= STANDS_OUT * chance:
        return none
    found = np.flatnonzero(np.abs(vector) > STANDS_OUT * level / value)
    return found, vector[found] / np.abs(vector).max()


def begin(sample: Sample, chosen: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Zero weights; factors small and random, but those of an interaction on their sides of it."""
    yes = sample.label.sum()
    factors = np.random.default_rng(7).normal(0, 0.02, (len(chosen), FACTORS))
    for f, (found, side) in enumerate(seeds):
        factors[np.searchsorted(chosen, found), f] = 0.3 * side
    return Model(sample.vocabulary[chosen], float(np.log((yes + 1) / (len(sample.label) - yes + 1))), np.zeros(len(chosen)), factors)


def loss(model: Model, sample: Sample, chosen: np.ndarray) -> float:
    raw, _ = model.raw(len(sample.label), *sample.of(chosen))
    return float(np.logaddexp(0, np.where(sample.label > 0, -raw, raw)).mean())


def learn(sample: Sample) -> Model:
    """The machine that the sample gives: terms with weights, then interactions as long as unseen rows gain by them."""
    chosen = telling(sample)
    unseen = np.arange(len(sample.label)) % 5 == 0  # rows are in order of their hashes
    part, rest = sample.rows(~unseen), sample.rows(unseen)  # a copy of the sample in all
    seeds: list[tuple[np.ndarray, np.ndarray]] = []
    if 0 < part.label.sum() < len(part.label) and len(rest.label):
        model = fit(begin(part, chosen, seeds), *part.of(chosen), part.label)
        best = loss(model, rest, chosen)
        while best > SETTLED and len(seeds) < FACTORS:
            raw, _ = model.raw(len(part.label), *part.of(chosen))
            found = interacting(part, part.label - sigmoid(raw))
            more = [*seeds, found]
            wider = np.union1d(chosen, found[0])
            if not len(found[0]):
                break
            model = fit(begin(part, wider, more), *part.of(wider), part.label)
            if (now := loss(model, rest, wider)) > 0.95 * best:
                break
            chosen, seeds, best = wider, more, now
    doc, at = sample.of(chosen)
    model = fit(begin(sample, chosen, seeds), doc, at, sample.label)
    model.bias -= dividing(model.raw(len(sample.label), doc, at)[0], sample.label)
    return model


def fit(model: Model, doc: np.ndarray, term: np.ndarray, label: np.ndarray, epochs: int = 60, batch: int = 512, rate: float = 0.05, shrink: float = 1e-5) -> Model:
    """Adam on the logistic loss.  doc ascending."""
    n, rng = len(label), np.random.default_rng(7)
    theta = [np.array([model.bias]), model.weights, model.factors]
    moment = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    first = np.searchsorted(doc, np.arange(n + 1))
    step = 0
    for _ in range(epochs if len(model.terms) else 0):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows, step = order[at : at + batch], step + 1
            size = first[rows + 1] - first[rows]
            pick = np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            d, t = np.repeat(np.arange(len(rows)), size), term[pick]
            model.bias = float(theta[0][0])
            raw, sums = model.raw(len(rows), d, t)
            off = (sigmoid(raw) - label[rows]) / len(rows)
            m = len(model.terms)
            grads = [
                np.array([off.sum()]),
                np.bincount(t, off[d], m) + shrink * model.weights,
                np.stack([np.bincount(t, off[d] * (sums[d, f] - model.factors[t, f]), m) for f in range(model.factors.shape[1])], 1) + shrink * model.factors,
            ]
            for x, g, (a, b) in zip(theta, grads, moment, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    model.bias = float(theta[0][0])
    return model


def dividing(raw: np.ndarray, label: np.ndarray) -> float:
    """The score with the fewest of the sample on the wrong side; of equals, a quarter into the widest gap: below it lie
    texts without any term, all at one score, above it texts with more or fewer."""
    order = np.argsort(raw, kind="stable")
    raw, label = raw[order], label[order]
    gap = np.diff(raw)
    wrong = np.cumsum(label)[:-1] + (1 - label).sum() - np.cumsum(1 - label)[:-1]
    wrong = np.where(gap > 1e-9, wrong, np.inf)
    if not len(gap) or np.isinf(wrong).all():
        return 0.0
    k = int(np.argmax(np.where(wrong == wrong.min(), gap, -1)))
    return float(0.75 * raw[k] + 0.25 * raw[k + 1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model that a bounded sample of the labels that aren't held out gives."""
    usable = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & ~held_out(label_id))
    usable = usable.groupBy(F.col(label_id).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # so many rows of 12 bytes are broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    texts = texts.groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    # a text that was copied, edited or not, is one witness
    marks = [f"m{k}" for k in range(SKETCH)]
    marked = texts.mapInArrow(sketch_kernel, ", ".join(["text string, toxic int", *(f"{m} long" for m in marks)]))
    texts = marked.groupBy("toxic", *marks).agg(F.min("text").alias("text"))
    texts = materialize(texts.select("text", "toxic", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size")), "labelled")
    sizes = texts.select("h", "size", "toxic").orderBy("h").collect()  # `sample` rows at most
    size = np.cumsum([r["size"] or 0 for r in sizes])
    sizes = sizes[: int(np.searchsorted(size, sample_bytes, "right"))]
    yes = sum(r["toxic"] for r in sizes)
    if not 0 < yes < len(sizes):
        return Model(np.zeros(0, np.uint64), float(np.log((yes + 1) / (len(sizes) - yes + 2))), np.zeros(0), np.zeros((0, FACTORS)))  # without labels below a half
    used = texts.filter(F.col("h") <= sizes[-1]["h"]).orderBy("h", "toxic").select("text", "toxic")
    held = used.mapInArrow(term_kernel, "toxic int, terms array<long>").toArrow()  # a term for each byte at most
    lists, label = held.column("terms"), held.column("toxic").to_numpy().astype(float)
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in lists.chunks])
    every = np.concatenate([c.flatten().to_numpy() for c in lists.chunks]).view(np.uint64)
    del held, lists
    doc = np.repeat(np.arange(len(label), dtype=np.int32), sizes)
    order = np.argsort(every)  # numbered in place of np.unique, which holds several times as much
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])
    vocabulary, number = every[new], np.empty(len(every), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    del every, order, new
    return learn(Sample(vocabulary, doc, number, label))


def scored(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, in place of a column of that name."""
    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, ends in text_blocks(batches, text_col):
            columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(data, ends))], names=[*(f.name for f in kept), name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", **options: object) -> DataFrame:
    """docs that score below 0.5; columns unchanged."""
    name = fresh(docs.columns, "_halyard_score")
    out = scored(docs, train(docs, labels, text_col=text_col, **options), text_col=text_col, name=name)
    return out.filter(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
