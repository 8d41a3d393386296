"""Shell words of a command line. No SQL form exists, so this is an Arrow-batched helper."""
from __future__ import annotations

import json
import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def words(text: str | None) -> list[str] | None:
    """A JSON list as it is, else shell words; an unbalanced quote falls back to blanks."""
    if text is None:
        return None
    s = text.strip()
    if s.startswith("[") and s.endswith("]"):
        try:
            got = json.loads(s)
            if isinstance(got, list):
                return [str(x) for x in got]
        except ValueError:
            pass
    try:
        return shlex.split(s)
    except ValueError:
        return s.split()


@F.pandas_udf(ArrayType(StringType()))
def split_argv(c: pd.Series) -> pd.Series:
    return c.map(words)
