"""Secrets in command lines and argument lists are hidden.

A line is read option by option: the name decides, whatever its spelling, and
what is given to it goes. Passwords in addresses and bearer headers are found by
their own signs. Everything else stays as it was, byte for byte.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

HIDDEN = "[REDACTED]"
# Fixed values (P26): arguments after which the next argument is a secret.
SECRET_FLAGS = ("--password", "--passwd", "--token", "--api-key", "--secret", "--client-secret", "--access-key")
#: The same names within a line may also be written with an underscore or in one word.
_NAMES = frozenset(f.lstrip("-").replace("-", join) for f in SECRET_FLAGS for join in ("-", "_", ""))
#: Signs that something may have to be hidden; lines without any are returned at once.
_SIGN = re.compile(r"-[A-Za-z]|://|authorization", re.I)
_OPTION = re.compile(r"-([A-Za-z]+(?:[-_][A-Za-z]+)?)(?=[=\s])")
_WHOLE_TOOL = re.compile(r"\bsshpass$", re.I)
_GIVEN = re.compile(r"(=|\s+)(\S+)")
_WORD, _GAP = re.compile(r"\S+"), re.compile(r"\s*")
_HEADER, _TOKEN = re.compile("authorization", re.I), re.compile(r"[^\s'\"]+")


def _option_values(line: str):
    """Spans of what secret options are given; ``sshpass -p`` counts as one."""
    done = 0
    for m in _OPTION.finditer(line):
        name = m.group(1).lower()
        if m.start() < done:
            continue  # an option that was itself given as a secret gives nothing
        if name in _NAMES:
            given = _GIVEN.match(line, m.end())
        elif name == "p" and line[m.end()] != "=":
            words = line[max(0, m.start() - 80):m.start()]
            tool = words.rstrip()
            given = _GIVEN.match(line, m.end()) if tool != words and _WHOLE_TOOL.search(tool) else None
        else:
            continue
        if given:
            done = given.end()
            yield given.span(2)


def _address_passwords(line: str):
    """Spans of passwords in ``scheme://user:password@host``."""
    at = line.find("://")
    while at >= 0:
        word = _WORD.match(line, at + 3)
        login = word.group().split("/", 1)[0] if word else ""
        user, colon, rest = login.partition(":")
        password, mark, _ = rest.partition("@")
        if user and "@" not in user and colon and mark and password:
            begin = at + 3 + len(user) + 1
            yield begin, begin + len(password)
        at = line.find("://", at + 3)


def _bearer_tokens(line: str):
    """Spans of what follows ``Authorization: Bearer``, up to a blank or quotation mark."""
    skip = lambda at: _GAP.match(line, at).end()
    for m in _HEADER.finditer(line):
        colon = skip(m.end())
        scheme = skip(colon + 1) if line[colon:colon + 1] == ":" else len(line)
        begin = skip(scheme + 6) if line[scheme:scheme + 6].lower() == "bearer" else scheme + 6
        token = _TOKEN.match(line, begin) if begin > scheme + 6 else None
        if token:
            yield token.span()


def hide(line: str) -> str:
    """The line with its secrets replaced."""
    if not _SIGN.search(line):
        return line
    for find in (_option_values, _address_passwords, _bearer_tokens):
        done, out = 0, []
        for begin, end in find(line):
            out += [line[done:begin], HIDDEN]
            done = end
        line = "".join([*out, line[done:]]) if out else line
    return line


def hide_words(argv: list[str | None]) -> list[str | None]:
    """Arguments hidden one by one; what follows a secret flag goes whole."""
    low = [a.lower() if a is not None else "" for a in argv]
    by_sshpass = bool(low) and low[0].rsplit("/", 1)[-1] == "sshpass"
    return [HIDDEN if i and (low[i - 1] in SECRET_FLAGS or (by_sshpass and low[i - 1] == "-p")) else a if a is None else hide(a) for i, a in enumerate(argv)]


@F.arrow_udf(T.StringType())
def _lines(c: pa.Array) -> pa.Array:
    return pa.array([None if line is None else hide(line) for line in c.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _arguments(c: pa.Array) -> pa.Array:
    return pa.array([None if argv is None else hide_words(argv) for argv in c.to_pylist()], pa.list_(pa.string()))


def redact_command(c: Column) -> Column:
    return _lines(c.cast("string"))


def redact_argv(argv: Column) -> Column:
    return _arguments(argv)
