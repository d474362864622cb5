"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .arrow import map_columns

#: Where the vocabulary file lies; a parameter of all operators that count tokens. It is sent to the executors that do not have it there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's tokenizer splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of ``path``, or of the copy sent along with the job, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("sievegrid", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, *keep, n_tokens)`` of the rows with an id; a null text has no tokens. Whole texts are counted, strings of special tokens as ordinary text."""
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)
    kinds = dict(df.dtypes)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))

    def run(b: dict[str, list]) -> dict[str, list]:
        enc = encoder(vocabulary)
        return {k: b[k] for k in ("id", *keep)} | {"n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["__text"]]}

    return map_columns(spread(rows), run, ", ".join([f"id {kinds[id_col]}", *[f"`{k}` {kinds[k]}" for k in keep], "n_tokens bigint"]))
