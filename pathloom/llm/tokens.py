"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are, and which is used.
TOKENIZER_DIR = os.environ.get("PATHLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Fixed value: how texts are split before byte pairs are merged, as published for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens; null and empty texts have 0.

    The vocabulary file must be at ``path`` on every executor."""
    where = path or f"{TOKENIZER_DIR}/{TOKENIZER}"
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(where)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), pa.array(n, pa.int64())], names=[*rest, name])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{ddl}, `{name}` long")
