"""Token counts and ids of texts by public byte-pair vocabularies, read from files whose paths are given."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern that parts a text before merging: contractions, letters, numbers, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_held: dict = {}


def _encoding(path: str):
    if path not in _held:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _held[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[path]


def tokenize(text: Column, path: str) -> Column:
    """The ids of a text by a file of ranks; null for null."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        own = _encoding(path)
        return pd.Series([None if t is None else own.encode_ordinary(t) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of ids; without a file, of words, numbers and other signs (an estimate, within the JVM)."""
    if path is None:
        return F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"), F.lit(0)))

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        own = _encoding(path)
        return pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in texts], dtype="Int32")

    return run(text)


def content_id(*parts: Column) -> Column:
    """A name of 64 hexadecimal digits for contents: equal for equal parts alone, nulls and empty strings apart."""
    framed = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *framed), 256)
