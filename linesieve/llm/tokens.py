"""Sizes of texts in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file with one "base64 rank" a line; a parameter of every operator that counts tokens.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for rb in batches:
            enc = enc or encoder(path)
            n = np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in rb.column(text_at).to_pylist()), np.int64, rb.num_rows)
            keep = [i for i in range(rb.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in keep), pa.array(n)], names=[*(rb.schema.names[i] for i in keep), "n_tokens"])

    return run


def with_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None, tokenizer_path: str = TOKENIZER_PATH) -> DataFrame:
    """``id``, the columns of ``keep`` (new name: column) and ``n_tokens``; a null or empty text has 0 tokens."""
    keep = keep or {}
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).alias(n) for n, c in keep.items()), F.col(text_col).alias("_text"))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in ["id", *keep]) + ", n_tokens bigint"
    return chosen.mapInArrow(_count(tokenizer_path, len(keep) + 1), schema)
