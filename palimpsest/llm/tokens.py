"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Ranks of a byte-level BPE vocabulary; any file of the same format can be given instead.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(df: DataFrame, keep: list[str], text: str, path: str = TOKENIZER_PATH) -> DataFrame:
    """(keep columns, n_tokens): the size of each whole text; null and empty texts have 0 tokens."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(keep, names)], df[text].alias("t"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            sizes = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in b.column("t").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    schema = ", ".join([*[f"{n} {kinds[n]}" for n in names], "n_tokens long"])
    return rows.mapInArrow(run, schema).toDF(*keep, "n_tokens")
