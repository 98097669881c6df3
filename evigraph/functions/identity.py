"""Hashes that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """BLAKE2b of 128 bits, in hex."""
    return content.map(lambda x: None if x is None else hashlib.blake2b(x.encode() if isinstance(x, str) else bytes(x), digest_size=16).hexdigest())


@F.pandas_udf(T.StringType())
def stable_id(prefix: pd.Series, parts: pd.Series) -> pd.Series:
    """prefix::BLAKE2b of 80 bits of the parts joined by ::."""
    return pd.Series([f"{p}::{hashlib.blake2b('::'.join(map(str, x)).encode(), digest_size=10).hexdigest()}" for p, x in zip(prefix, parts, strict=True)])
