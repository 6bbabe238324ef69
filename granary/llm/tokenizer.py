"""Token counts of a public byte-level BPE vocabulary, given by path."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's place on this machine; a cluster passes its own.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level BPE split: contractions, words, numbers, other marks, blanks. Fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(ranks: bytes):
    """The encoder of a rank file's content."""
    import tiktoken

    mergeable = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("granary", pat_str=SPLIT, mergeable_ranks=mergeable, special_tokens={})


def with_token_counts(df: DataFrame, keep: list[str], text: str, path: str = VOCABULARY) -> DataFrame:
    """(*keep, tokens): the tokens of every text, 0 of a null one.

    The vocabulary (a megabyte) is read by the driver and broadcast, so executors need no file.
    """
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shared.value)
        for b in batches:
            yield b[keep].assign(tokens=[0 if t is None else len(enc.encode_ordinary(t)) for t in b["__text"]])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInPandas(count, f"{kinds}, tokens long")
