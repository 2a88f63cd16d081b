"""Byte-pair token ids in Arrow batches, for a vocabulary and merges that the caller supplies."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import functions as F

from halyard.functions.text import BOS, EOS, PRETOKEN

WORD_END = "</w>"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next from 256 on."""
    prints = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()


@dataclass
class Merges:
    """Vocabulary and merge ranks.  Words are remembered, up to `memory` of them."""

    vocab: dict[str, int]
    ranks: dict[tuple[str, str], int]
    memory: int = 100_000
    seen: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def from_lines(cls, vocab: dict[str, int], lines: list[str]) -> Merges:
        """Merge lines in rank order; one that isn't two parts is no merge but keeps its rank."""
        parts = [line.split(" ") for line in lines]
        return cls(vocab, {(p[0], p[1]): i for i, p in enumerate(parts) if len(p) == 2})

    @classmethod
    def from_json(cls, text: str) -> Merges:
        """Of a tokenizer file, whose merges are lines or pairs."""
        model = json.loads(text)["model"]
        return cls.from_lines(model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]])

    def __getstate__(self) -> dict:
        return {"vocab": self.vocab, "ranks": self.ranks, "memory": self.memory, "seen": {}}

    def pieces(self, word: str) -> list[str]:
        """Symbols of a word when no neighbours can be merged any more, the best rank always first."""
        symbols = [*word[:-1], word[-1:] + WORD_END] if word else []
        while len(symbols) > 1:
            rank, pair = min((self.ranks.get(p, len(self.ranks) + 1 << 20), p) for p in zip(symbols, symbols[1:], strict=False))
            if pair not in self.ranks:
                break
            joined, i = [], 0
            while i < len(symbols):
                both = tuple(symbols[i : i + 2]) == pair
                joined.append("".join(pair) if both else symbols[i])
                i += 1 + both
            symbols = joined
        return symbols

    def ids(self, text: str) -> list[int]:
        unknown, out = self.vocab.get("<|endoftext|>", EOS), []
        for token in regex.findall(PRETOKEN, text.lower()):
            if token not in self.seen:
                if len(self.seen) >= self.memory:
                    self.seen.clear()
                word = token if token in ("<|startoftext|>", "<|endoftext|>") else "".join(ALPHABET[b] for b in token.encode())
                symbols = [word] if word in self.vocab and word.startswith("<|") else self.pieces(word)
                self.seen[token] = [self.vocab.get(s, unknown) for s in symbols]
            out += self.seen[token]
        return out


def token_ids(merges: Merges) -> Callable:
    """A UDF from text to ids without special tokens around; null text gives null."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        which, distinct = pd.factorize(texts)  # each distinct text of a batch once; a null is -1
        found = [merges.ids(t) for t in distinct]
        return pd.Series([found[i] if i >= 0 else None for i in which], dtype=object)

    return run


def special_ids(vocab: dict[str, int]) -> tuple[int, int]:
    return vocab.get("<|startoftext|>", BOS), vocab.get("<|endoftext|>", EOS)
