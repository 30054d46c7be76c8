"""Unified diffs of two texts, in Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unified(before: str | None, after: str | None, path: str) -> str:
    """The diff of two texts; a missing side counts as empty, equal sides give an empty diff."""
    a, b = (before or "").splitlines(), (after or "").splitlines()
    return "\n".join(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm=""))


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([unified(a, b, p) for a, b, p in zip(before, after, path, strict=True)])
