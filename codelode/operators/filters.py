"""Typed filter operators and their combination."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.operators.fields import field_kind, resolve_field, typed_value

# --- Fixed values: operator names --------------------------------------------
OPERATORS = [
    "=", "!=", ">", ">=", "<", "<=", "LIKE", "ILIKE",
    "IN", "NOT IN", "IS NULL", "IS NOT NULL", "CONTAINS",
]


@dataclass(frozen=True)
class QueryFilter:
    field: str
    operator: str
    value: Any = None


def _text_of(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return F.array_join(column, " ") if field_kind(df, name) == "array<string>" else column


def _list(value: Any, operator: str) -> list:
    if not isinstance(value, (list, tuple, set)):
        raise ValueError(f"{operator} needs a list of values")
    return list(value)


def json_contains(json_text: Column, wanted: dict) -> Column:
    """JSON containment: every given key holds the given value; lists must
    hold every given element; nested objects are checked the same way."""
    variant = F.try_parse_json(json_text)
    elements = "array<variant>"

    def both(parts: list[Column]) -> Column:
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

    def holds(value: Any):
        return lambda item: check(item, value)

    def check(at: Column, value: Any) -> Column:
        if isinstance(value, dict):
            return both([F.schema_of_variant(at).startswith("OBJECT"), *(check(_member(at, k), v) for k, v in value.items())])
        if isinstance(value, (list, tuple)):
            items = F.try_variant_get(at, "$", elements)
            return both([F.schema_of_variant(at).startswith("ARRAY"), *(F.exists(items, holds(v)) for v in value)])
        if value is None:
            return F.is_variant_null(at)
        kind = F.schema_of_variant(at)
        if isinstance(value, bool):
            return both([kind == "BOOLEAN", F.try_variant_get(at, "$", "boolean") == value])
        if isinstance(value, int) and -(10**38) < value < 10**38:  # as whole numbers: doubles would merge large ones
            exact = F.try_variant_get(at, "$", "decimal(38,0)") == F.lit(str(value)).cast("decimal(38,0)")
            whole = F.try_variant_get(at, "$", "double") == F.floor(F.try_variant_get(at, "$", "double"))
            return both([~kind.isin("STRING", "BOOLEAN"), exact, whole])
        if isinstance(value, (int, float)):
            return both([~kind.isin("STRING", "BOOLEAN"), F.try_variant_get(at, "$", "double") == float(value)])
        return both([kind == "STRING", F.try_variant_get(at, "$", "string") == str(value)])

    return check(variant, wanted)


def _member(at: Column, key: str) -> Column:
    """A member by its name, whatever characters it has."""
    return F.element_at(F.try_variant_get(at, "$", "map<string,variant>"), F.lit(key))


def condition(df: DataFrame, f: QueryFilter) -> Column:
    """One filter as a predicate.  Values are literals, never SQL text."""
    name = resolve_field(f.field)
    kind = field_kind(df, name)
    operator = " ".join(f.operator.upper().split())
    operator = {"==": "=", "<>": "!="}.get(operator, operator)
    if operator not in OPERATORS:
        raise ValueError(f"Unsupported operator '{f.operator}'. Valid: {', '.join(OPERATORS)}")
    column = F.col(f"`{name}`")
    if operator == "IS NULL":
        return column.isNull()
    if operator == "IS NOT NULL":
        return column.isNotNull()
    if operator == "CONTAINS":
        if name == "metadata_json":
            return json_contains(column, f.value)
        if kind.startswith("array"):
            return F.array_contains(column, F.lit(f.value))
        return column.contains(F.lit(str(f.value)))
    text = _text_of(df, name)
    if operator in ("LIKE", "ILIKE"):
        return text.like(f.value) if operator == "LIKE" else text.ilike(f.value)
    if operator in ("IN", "NOT IN"):
        values = [typed_value(v, kind, name) for v in _list(f.value, operator)]
        return text.isin(values) if operator == "IN" else ~text.isin(values)
    value = F.lit(typed_value(f.value, kind, name))
    return {
        "=": lambda: text == value, "!=": lambda: text != value,
        ">": lambda: text > value, ">=": lambda: text >= value,
        "<": lambda: text < value, "<=": lambda: text <= value,
    }[operator]()


def combine(conditions: list[Column], logic: str = "AND") -> Column:
    if not conditions:
        return F.lit(True)
    if logic.upper() not in ("AND", "OR"):
        raise ValueError("filters combine with AND or OR")
    return reduce((lambda a, b: a & b) if logic.upper() == "AND" else (lambda a, b: a | b), conditions)


def apply_filters(df: DataFrame, filters: list[QueryFilter], logic: str = "AND") -> DataFrame:
    return df.filter(combine([condition(df, f) for f in filters], logic)) if filters else df


# --- Fixed values: comparison names in nested filter dictionaries -------------
RANGE_NAMES = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def to_filter_dict(filters: list[QueryFilter], logic: str = "AND") -> dict:
    """Filters in the nested form document stores use (match / range / must …)."""

    def one(f: QueryFilter) -> dict:
        op = f.operator.upper()
        negated = {"must_not": True} if op in ("!=", "NOT IN", "IS NOT NULL") else {}
        if op in ("=", "!="):
            body = {"key": f.field, "match": {"value": f.value}}
        elif op in RANGE_NAMES:
            body = {"key": f.field, "range": {RANGE_NAMES[op]: f.value}}
        elif op in ("IN", "NOT IN"):
            body = {"key": f.field, "match": {"any": f.value}}
        elif op in ("IS NULL", "IS NOT NULL"):
            body = {"is_empty": {"key": f.field}}
        elif op == "CONTAINS":
            body = {"key": f.field, "match": {"text": str(f.value)}}
        else:
            raise ValueError(f"Unsupported operator '{f.operator}' for nested filters")
        return body | negated

    parts = [one(f) for f in filters]
    if len(parts) < 2:
        return parts[0] if parts else {}
    return {"must" if logic.upper() == "AND" else "should": parts}


def from_filter_dict(df: DataFrame, tree: dict) -> Column:
    """The nested form as a predicate."""
    if not tree:
        return F.lit(True)
    lists = {w: tree[w] for w in ("must", "should", "must_not") if isinstance(tree.get(w), list)}
    if lists:
        parts = [from_filter_dict(df, part) for part in lists.get("must", [])]
        if lists.get("should"):
            parts.append(combine([from_filter_dict(df, part) for part in lists["should"]], "OR"))
        # A row where the excluded part is NULL does not match it, so it stays.
        parts += [~F.coalesce(from_filter_dict(df, part), F.lit(False)) for part in lists.get("must_not", [])]
        return combine(parts)
    if tree.get("must_not") is True and ("range" in tree or "text" in tree.get("match", {})):
        return ~F.coalesce(from_filter_dict(df, {k: v for k, v in tree.items() if k != "must_not"}), F.lit(False))
    if "is_empty" in tree:
        f = QueryFilter(tree["is_empty"]["key"], "IS NOT NULL" if tree.get("must_not") else "IS NULL")
        return condition(df, f)
    if "range" in tree:
        symbols = {v: k for k, v in RANGE_NAMES.items()}
        return combine(
            [condition(df, QueryFilter(tree["key"], symbols[k], v)) for k, v in tree["range"].items()]
        )
    match = tree["match"]
    if "any" in match:
        return condition(df, QueryFilter(tree["key"], "NOT IN" if tree.get("must_not") else "IN", match["any"]))
    if "text" in match:
        return condition(df, QueryFilter(tree["key"], "CONTAINS", match["text"]))
    return condition(df, QueryFilter(tree["key"], "!=" if tree.get("must_not") else "=", match["value"]))
