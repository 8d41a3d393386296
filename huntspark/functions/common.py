"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Lower rank is worse.
SEVERITY_RANK = {"P0": 0, "P1": 1, "P2": 2, "P3": 3}


def text_or_null(c: Column) -> Column:
    """Blank text counts as missing."""
    s = F.trim(c.cast("string"))
    return F.when(s != "", c.cast("string"))


def first_present(df: DataFrame, names) -> Column:
    """First non-empty value among those of ``names`` that exist in ``df``."""
    have = [text_or_null(F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def severity_rank(c: Column, default: int = 9) -> Column:
    out = F.lit(default)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), rank.cast("int") + 1)


def digest(prefix: str, *cols: Column, length: int = 16) -> Column:
    """``prefix`` plus the head of a SHA-256 over the columns joined by a bar."""
    body = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.concat(F.lit(prefix), F.substring(F.sha2(body, 256), 1, length))


def any_of(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def first_match(*pairs, default=None) -> Column:
    """Ordered ``(test, value)`` pairs: the first true test wins."""
    out = default if isinstance(default, Column) else F.lit(default)
    for test, value in reversed(pairs):
        out = F.when(test, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def matched_names(*pairs) -> Column:
    """Names of all true tests, in rule order."""
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in pairs]))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Repeating a long expression in the tree makes plans explode; a lambda
    variable keeps it a leaf.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
