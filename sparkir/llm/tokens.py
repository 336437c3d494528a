"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
CHARACTERS_AT_ONCE = 1 << 20


def token_counter(folder: str = TOKENIZERS, file: str = VOCABULARY):
    """A function of one column: the number of tokens of whole texts; 0 for null and for blank texts of no tokens.

    The vocabulary is read once per Python worker from ``folder``, which all executors must have."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(os.path.join(folder, file))
        t.encode_special_tokens = True
        for s in parts:
            texts, out, batch, held = s.fillna("").tolist(), [], [], 0
            for x in texts:  # long texts in small batches
                batch.append(x)
                held += len(x)
                if held > CHARACTERS_AT_ONCE or len(batch) >= 256:
                    out += [len(e) for e in t.encode_batch_fast(batch, add_special_tokens=False)]
                    batch, held = [], 0
            out += [len(e) for e in t.encode_batch_fast(batch, add_special_tokens=False)]
            yield pd.Series(out, index=s.index, dtype="int64")

    def apply(text: Column | str) -> Column:
        return count(text)

    return apply
