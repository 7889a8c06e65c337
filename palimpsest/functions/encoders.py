"""Text encoders. The signed hashing encoder needs blake2b, which Spark lacks, so it runs on Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import MEMORY_STOP, MEMORY_WORD


@lru_cache(500_000)
def _slot(feature: str, dim: int) -> tuple[int, float]:
    raw = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return raw % dim, 1.0 if raw >> 63 else -1.0


def hash_vector(text: str | None, dim: int = 384) -> np.ndarray:
    """Unit vector of words (1.0), word pairs (0.65) and character trigrams (0.20); zero for a text without words."""
    v = np.zeros(dim, np.float32)
    words = [w for w in (x.lower() for x in re.findall(MEMORY_WORD, text or "")) if w not in MEMORY_STOP]
    feats = [(f"w:{w}", 1.0) for w in words] + [(f"b:{a}_{b}", 0.65) for a, b in zip(words, words[1:])]
    feats += [(f"c:{p[i : i + 3]}", 0.20) for w in words if len(w) >= 4 for p in [f"^{w}$"] for i in range(len(p) - 2)]
    for f, weight in feats:
        at, sign = _slot(f, dim)
        v[at] += sign * weight
    n = float(np.linalg.norm(v))
    return v / n if n else v


def encoder_udf(make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of any encoder; ``make`` builds it once per executor process, batches go through it whole.

    Vectors are brought to unit length; null texts have null vectors.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for b in batches:
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            known = b[b.notna()]
            if len(known):
                m = np.asarray(encode(known.tolist()), np.float32)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                out[known.index] = list(m / np.where(n > 0, n, 1))
            yield out

    return F.pandas_udf(run, "array<float>")


def hash_encoder(dim: int = 384) -> Callable[[Column], Column]:
    return encoder_udf(lambda: lambda texts: np.stack([hash_vector(t, dim) for t in texts]))
