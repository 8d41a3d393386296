"""URL columns. Built on regexes: malformed URLs must not fail or turn NULL."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import let

_AUTH = r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"


def _after_authority(url: Column, empty_path: str) -> Column:
    rest = F.regexp_replace(F.regexp_replace(url, _AUTH, ""), r"(?s)#.*$", "")
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1)
    path = F.when(path == "", F.lit(empty_path)).otherwise(path)
    return F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)


def url_host(url: Column) -> Column:
    """Authority of an absolute URL in lower case, NULL without one."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTH, 1))
    return F.when(h != "", h)


def normalize_url_path(c: Column) -> Column:
    """Path and query in lower case; a text without scheme is only lowered."""
    s = F.trim(F.coalesce(c, F.lit("")))
    return F.lower(F.when(s.contains("://"), _after_authority(s, "")).otherwise(s))


def path_query(c: Column) -> Column:
    """Path and query of a URL, a request line (``GET /x HTTP/1.1``) or a bare path."""
    s = F.trim(F.coalesce(c, F.lit("")))
    line = F.regexp_extract(s, rf"(?i)^(?:{METHODS})\s+(\S+)", 1)
    s = F.when(line != "", line).otherwise(s)
    s = F.when(s.startswith("//"), F.concat(F.lit("http:"), s)).otherwise(s)
    return F.when(s.contains("://"), _after_authority(s, "/")).otherwise(s)


def percent_decode(c: Column) -> Column:
    """One round; malformed escapes and plus signs stay as they are."""
    def decode(t):
        safe = F.regexp_replace(F.replace(t, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(t.contains("%"), F.coalesce(F.try_url_decode(safe), t)).otherwise(t)

    return let(c, decode)


def decoded_text(c: Column) -> Column:
    """Lower case, plus as blank, two rounds of percent decoding, backslash as slash."""
    s = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("+"), F.lit(" "))
    return F.translate(percent_decode(percent_decode(s)), "\\", "/")


def urls_correlate(a: Column, b: Column) -> Column:
    """Same decoded path, and the path is there or the queries share enough.

    Without a path: one query inside the other, or two tokens of four or more
    characters of the first found in the second.
    """
    path = lambda s: F.regexp_extract(s, r"(?s)^([^?]*)", 1)
    query = lambda s: F.regexp_extract(s, r"(?s)^[^?]*\?(.*)$", 1)
    parts = lambda c: let(decoded_text(path_query(c)), lambda t: F.struct(t.alias("t"), path(t).alias("p"), query(t).alias("q")))

    def test(s):
        x, y = s["x"], s["y"]
        tokens = F.filter(F.split(x["q"], r"[&=?'\s]+"), lambda t: F.length(t) >= 4)
        shared = F.size(F.filter(tokens, lambda t: y["q"].contains(t)))
        by_query = (x["q"] != "") & (y["q"] != "") & (x["q"].contains(y["q"]) | y["q"].contains(x["q"]) | (shared >= 2))
        return (x["t"] != "") & (y["t"] != "") & (x["p"] == y["p"]) & ((x["p"] != "") | by_query)

    return let(F.struct(parts(a).alias("x"), parts(b).alias("y")), test)
