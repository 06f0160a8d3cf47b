"""Compressed lengths."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = 22


@cache
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL)


def _sizes(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else len(_compressor().compress(t.encode())) for t in text], dtype="Int64")


def zstd_length(c: Column | str) -> Column:
    """Bytes of the text's zstd frame; Spark has no such function, so it runs on Arrow batches."""
    return F.pandas_udf(_sizes, "long")(c)
