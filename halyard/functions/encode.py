"""Encoders as Arrow UDFs: whoever has a model supplies it; the hashing encoder stands in for one in tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.config import ENCODE_BATCH, TINY

Encoder = Callable[[list], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """STUB, not a model: words hashed to signed dimensions."""

    def encode(items: list) -> np.ndarray:
        out = np.zeros((len(items), dim), np.float32)
        for row, text in zip(out, items, strict=True):
            for w in str(text).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        return out

    return encode


def unit(rows: np.ndarray) -> np.ndarray:
    n = np.sqrt((rows.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.where(n < TINY, rows, rows / np.maximum(n, TINY))


def text_encoder(load: Callable[[], Encoder]) -> Callable:
    """A UDF from text to a unit vector.  load() runs once a task, where sessions and threads are set up."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            known = texts.notna()
            vectors = iter(unit(encode(texts[known].tolist()))) if known.any() else iter(())
            yield pd.Series([next(vectors) if k else None for k in known], dtype=object)

    return run


def encode_batches(items: DataFrame, load: Callable[[], Encoder], *, source: str, into: str = "embedding", error: str = "error", batch: int = ENCODE_BATCH) -> DataFrame:
    """items without `source` and with its vector, encoded `batch` at a time.

    A batch that fails is tried row by row; a row that fails alone gets a null vector and the reason in `error`.  Null
    sources are not encoded.
    """
    kept = [f for f in items.schema.fields if f.name != source]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.FloatType())), T.StructField(error, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()

        def one(item: object) -> tuple[np.ndarray | None, str | None]:
            try:
                return unit(encode([item]))[0].astype(np.float32), None
            except Exception as e:  # any failure of a caller's model is that row's outcome
                return None, f"{type(e).__name__}: {e}"

        for frame in frames:
            found: list[tuple[np.ndarray | None, str | None]] = [(None, "no input")] * len(frame)
            where = np.flatnonzero(frame[source].notna().to_numpy())
            for at in range(0, len(where), batch):
                pick = where[at : at + batch]
                values = frame[source].iloc[pick].tolist()
                try:
                    done = [(v.astype(np.float32), None) for v in unit(encode(values))]
                except Exception:
                    done = [one(v) for v in values]
                for i, d in zip(pick, done, strict=True):
                    found[i] = d
            out = frame.drop(columns=[source])
            out[into], out[error] = [v for v, _ in found], [e for _, e in found]
            yield out

    return items.mapInPandas(run, schema)


def agreeing(providers: DataFrame, *, gate: float = 0.99) -> DataFrame:
    """Of measured providers (provider, cosine, elapsed), the fastest that agrees with the reference run."""
    best = providers.filter(F.col("cosine") >= gate)
    return best.agg(F.min_by("provider", F.struct("elapsed", "provider")).alias("provider"), F.min("elapsed").alias("elapsed"))
