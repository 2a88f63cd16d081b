"""Search settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Knobs:
    """How a ranked list is cut.

    ratio: a result must reach this share of its query's best score.  threshold: and this score, inclusive or not.
    top_k: at most so many, None for all.  fallback: so many of the ratio-filtered results where the threshold leaves none.
    """

    threshold: float = 0.19
    ratio: float = 0.75
    top_k: int | None = None
    fallback: int = 0
    inclusive: bool = True


#: Rows of a result page, and how near its end the next one is asked for.
PAGE_SIZE, PREFETCH = 30, 6
#: Items encoded at once, and new vectors between two checkpoints of an index build.
ENCODE_BATCH, CHECKPOINT_EVERY = 4, 20
#: Longest uri and vector of an index record.
MAX_URI, MAX_VECTOR = 4096, 4096
#: Vectors whose elements are all smaller are treated as zero.
TINY = 1e-8
#: Scores below this are noise.
NOISE = 0.18
