"""Sizes of texts in tokens of a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the ranks lie by default, and the public split pattern that goes with them.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(documents: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, *keep): tokens of each whole text; a null text has none.

    The vocabulary file is read by the driver and broadcast (under 1 MB), so
    executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    held = documents.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) for t in batch.column(0).to_pylist()]
            names = batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), *batch.columns[1:]], names=["tokens", *names])

    rows = documents.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), id_col, *keep)
    schema = ", ".join(["tokens long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])])
    return rows.mapInArrow(run, schema).select(id_col, "tokens", *keep)
