"""A query from outside may only read."""

from __future__ import annotations

import re

_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_WRITES = re.compile(
    r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace\s+table|grant|revoke|set|reset|use|load|refresh|cache|uncache|msck|analyze|call|add|optimize|vacuum)\b",
    re.IGNORECASE,
)


def read_only(query: str) -> str:
    """The query if it is one SELECT or WITH statement without a writing word outside literals; else ValueError."""
    bare = _LITERAL.sub(" ", query).strip()
    bare = bare[:-1].rstrip() if bare.endswith(";") else bare
    if ";" in bare:
        raise ValueError("more than one statement")
    if not re.match(r"(select|with)\b", bare, re.IGNORECASE):
        raise ValueError("not a SELECT")
    if m := _WRITES.search(bare):
        raise ValueError(f"{m[1]} is not allowed")
    return query.strip().rstrip(";")
