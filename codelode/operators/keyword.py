"""The keyword language as one Spark predicate.

Terms - ``field:value``, ``exists(field)``, ``value_contains(field, "text")`` and
bare words - are rewritten in place as Spark SQL conditions.  Brackets, AND and
OR are left to Spark's own SQL parser, so precedence and nesting are Spark's.
Two terms side by side mean AND.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame

from codelode import catalog
from codelode.functions.sqltext import literal
from codelode.operators.fields import field_kind, resolve_field, typed_value

_VALUE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s(),:]+)"""
_TERM = re.compile(
    rf"""\s*(?:
      (?i:exists)\s*\(\s*(?P<exists>[A-Za-z_]\w*)\s*\)
    | (?i:value_contains)\s*\(\s*(?P<within>[A-Za-z_]\w*)\s*,\s*(?P<part>{_VALUE})\s*\)
    | (?P<field>[A-Za-z_]\w*)\s*:\s*(?P<value>{_VALUE})
    | (?P<bracket>[()])
    | (?P<logic>(?i:and|or)\b)
    | (?P<words>[A-Za-z_]\w*(?:\s+(?!(?i:and|or)\b)[A-Za-z_]\w*(?!\w|\s*:|\s*\())*)(?!\s*:)
    )\s*""",
    re.X,
)


def _contains(operand: str, value: str) -> str:
    """Case-insensitive substring; ``%`` and ``_`` stay wildcards."""
    return f"{operand} ILIKE {literal('%' + value.replace(chr(92), chr(92) * 2) + '%')}"


def _as_text(df: DataFrame, name: str) -> str:
    if field_kind(df, name) == "array<string>":
        return f"array_join(`{name}`, ' ')"
    return f"`{name}`"


def _unquote(value: str) -> str:
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def _condition(df: DataFrame, term: re.Match) -> str:
    if term["exists"]:
        name = resolve_field(term["exists"])
        field_kind(df, name)
        return f"`{name}` IS NOT NULL"
    if term["within"]:
        return _contains(_as_text(df, resolve_field(term["within"])), _unquote(term["part"]))
    if term["words"]:
        return _contains(_as_text(df, "code"), re.sub(r"\s+", " ", term["words"].strip()))
    name, value = resolve_field(term["field"]), _unquote(term["value"])
    if name == "language":
        return f"lower(`language`) = lower({literal(value)})"
    if name in catalog.SUBSTRING_FIELDS:
        return _contains(_as_text(df, name), value)
    typed = typed_value(value, field_kind(df, name), name)
    return f"{_as_text(df, name)} = {literal(typed)}"


def keyword_sql(df: DataFrame, query: str) -> str:
    """The query as a Spark SQL condition; an empty query is TRUE."""
    pieces: list[str] = []
    at, text = 0, (query or "").strip()
    complete = False                      # the last piece ends an operand
    while at < len(text):
        term = _TERM.match(text, at)
        closing = term and (term["logic"] or term["bracket"] == ")")
        if not term or (closing and not complete):
            raise ValueError(f"cannot read keyword query at: {text[at:at + 40]!r}")
        at = term.end()
        if term["logic"]:
            pieces.append(term["logic"].upper())
        elif term["bracket"] == ")":
            pieces.append(")")
        else:
            if complete:
                pieces.append("AND")
            pieces.append("(" if term["bracket"] else _condition(df, term))
        complete = not term["logic"] and term["bracket"] != "("
    if pieces and not complete:
        raise ValueError(f"keyword query ends too early: {query!r}")
    return " ".join(pieces) or "TRUE"


def keyword_filter(df: DataFrame, query: str | None) -> DataFrame:
    """Rows that match a keyword query; all rows for an empty one."""
    if not query or not query.strip():
        return df
    try:
        return df.filter(keyword_sql(df, query))
    except ParseException as error:
        raise ValueError(f"cannot read keyword query: {query!r}") from error
