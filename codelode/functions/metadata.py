"""Typed readers for the JSON text column ``metadata_json``.

The text is parsed once into a VARIANT (``parsed``); every reader is a plain
expression on that variant.  Malformed or empty JSON gives the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions.sqltext import EMPTY_LIST, literal, name

DEFAULTS = {
    "docstring": "", "analysis_method": "unknown", "chunking_method": "unknown",
    "complexity_score": 0, "parse_errors": 0, "char_count": 0,
    "has_type_hints": False, "has_async": False, "has_classes": False,
    "has_module": False, "tree_sitter_chunking_error": False,
    "tree_sitter_analyze_error": False, "success": True,
}
DETAIL_FIELDS = ["class_details", "function_details", "data_type_details"]


def parsed(json_text: str) -> Column:
    """The JSON object as a VARIANT, NULL unless it parses to an object."""
    v = f"try_parse_json({name(json_text)})"
    return F.expr(f"CASE WHEN startswith(schema_of_variant({v}), 'OBJECT') THEN {v} END")


# The readers take the name of the VARIANT column.  ``kind`` below is one of
# BOOLEAN, BIGINT, DOUBLE, DECIMAL(..), STRING, ARRAY<..>, OBJECT<..>, VOID.
def _parts(variant: str, field: str) -> dict[str, str]:
    value = f"variant_get({name(variant)}, '$.{field}', 'variant')"
    return {
        "value": value,
        "kind": f"schema_of_variant({value})",
        "text": f"try_variant_get({value}, '$', 'string')",
        "items": f"try_variant_get({value}, '$', 'array<string>')",
    }


def _read(template: str, variant: str, field: str, **more: str) -> Column:
    return F.expr(template.format(**_parts(variant, field), **more, empty=EMPTY_LIST))


def string_field(variant: str, field: str, default: str = "") -> Column:
    """Text of a field; JSON null reads as ``None``, booleans as True/False."""
    return _read(
        "CASE WHEN {value} IS NULL THEN {default} WHEN {kind} = 'VOID' THEN 'None'"
        " WHEN {kind} = 'BOOLEAN' THEN initcap({text}) ELSE {text} END",
        variant, field, default=literal(default),
    )


_TRUTH = (
    "CASE WHEN {value} IS NULL THEN {default} WHEN {kind} = 'VOID' THEN false"
    " WHEN {kind} = 'BOOLEAN' THEN {text} = 'true' WHEN {kind} = 'STRING' THEN {text} != ''"
    " WHEN startswith({kind}, 'ARRAY') THEN {text} != '[]' WHEN startswith({kind}, 'OBJECT') THEN {text} != '{{}}'"
    " ELSE try_cast({text} AS double) != 0 END"
)


def bool_field(variant: str, field: str, default: bool = False) -> Column:
    """Truthiness of a field: any non-empty text, list or object is true,
    also the text ``"false"``; zero, null and empty values are false."""
    return _read(_TRUTH, variant, field, default=literal(default))


def int_field(variant: str, field: str, default: int = 0) -> Column:
    """Whole number of a field.  Numbers are truncated; text counts only if it
    is a plain whole number; everything else gives the default."""
    return _read(
        "coalesce(CASE WHEN {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' THEN cast(try_cast({text} AS double) AS bigint)"
        " WHEN {kind} = 'STRING' AND {text} RLIKE '^-?[0-9]+$' THEN try_cast({text} AS bigint) END,"
        " cast({default} AS bigint))",
        variant, field, default=literal(default),
    )


def list_field(variant: str, field: str) -> Column:
    """List of texts; a single value becomes a one-element list."""
    return _read(
        "coalesce(CASE WHEN startswith({kind}, 'ARRAY') THEN {items} WHEN {kind} != 'VOID' THEN array({text}) END, {empty})",
        variant, field,
    )


def list_text_field(variant: str, field: str, default: str = "[]") -> Column:
    """The field as JSON list text; a single value is wrapped."""
    return _read(
        "CASE WHEN startswith({kind}, 'ARRAY') THEN {text} WHEN " + _TRUTH.replace("{default}", "false")
        + " THEN to_json(array({text})) ELSE {default} END",
        variant, field, default=literal(default),
    )


def error_nodes_field(variant: str, field: str = "nodes_with_errors") -> Column:
    """A positive count becomes a one-element list, zero an empty one."""
    return _read(
        "coalesce(CASE WHEN {kind} = 'BIGINT' THEN CASE WHEN try_cast({text} AS bigint) > 0 THEN array({text}) END"
        " WHEN startswith({kind}, 'ARRAY') THEN {items} WHEN {value} IS NOT NULL AND {kind} != 'VOID' THEN array({text}) END,"
        " {empty})",
        variant, field,
    )


def chunking_method_field(variant: str) -> Column:
    return F.coalesce(
        string_field(variant, "chunking_method", "unknown_chunking"), F.lit("unknown_chunking")
    )


def read_field(variant: str, field: str, kind: str) -> Column:
    """The reader that belongs to a chunk-table column."""
    if field == "nodes_with_errors":
        return error_nodes_field(variant)
    if kind == "array<string>":
        return list_field(variant, field)
    if field in DETAIL_FIELDS:
        return list_text_field(variant, field)
    default = DEFAULTS[field]
    if kind == "boolean":
        return bool_field(variant, field, default)
    if kind == "bigint":
        return int_field(variant, field, default)
    return string_field(variant, field, default)


NOT_IN_METADATA = {
    "filename", "language", "location", "code", "embedding", "embedding_model",
    "start", "end", "source_name", "metadata_json",
}


def promote(df: DataFrame, json_column: str = "metadata_json") -> DataFrame:
    """Every metadata column of the chunk table, read from the JSON text.

    Columns the relation already has are kept.
    """
    wanted = [
        (n, k) for n, k in catalog.CHUNK_COLUMNS if n not in NOT_IN_METADATA and n not in df.columns
    ]
    return (
        df.withColumn("_meta", parsed(json_column))
        .withColumns({n: read_field("_meta", n, k) for n, k in wanted})
        .drop("_meta")
    )


def default_metadata() -> Column:
    """JSON text for a language without analyzer."""
    none = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            none.alias("functions"), none.alias("classes"), none.alias("imports"),
            F.lit(0).alias("complexity_score"), F.lit(False).alias("has_type_hints"),
            F.lit(False).alias("has_async"), F.lit(False).alias("has_classes"),
            none.alias("decorators_used"), F.lit("default_basic").alias("analysis_method"),
        )
    )


def method_metadata(chunking_method: Column) -> Column:
    """``{"chunking_method": …}`` or '' where there is no method."""
    trimmed = F.trim(chunking_method)
    return F.when(
        F.coalesce(trimmed, F.lit("")) != "", F.to_json(F.struct(trimmed.alias("chunking_method")))
    ).otherwise("")


def fill_empty(value: Column, default: Column) -> Column:
    """A list default replaces missing and empty lists."""
    return F.when(value.isNull() | (F.size(value) == 0), default).otherwise(value)


def joined(items: Column) -> Column:
    """List as text with single spaces; NULL and empty give ''."""
    return F.coalesce(F.array_join(items, " "), F.lit(""))


def merge_metadata(left: dict[str, Column], right: dict[str, Column]) -> dict[str, Column]:
    """Two analyzers' findings as one: union of lists, the larger score, any
    flag, the longer detail text."""
    out = {}
    for field, kind in catalog.CHUNK_COLUMNS:
        if field not in left or field not in right:
            continue
        a, b = left[field], right[field]
        if kind == "array<string>":
            out[field] = F.array_sort(F.array_union(a, b))
        elif kind == "bigint":
            out[field] = F.greatest(a, b)
        elif kind == "boolean":
            out[field] = a | b
        elif field in DETAIL_FIELDS:
            out[field] = F.when(F.length(b) > F.length(a), b).otherwise(a)
        else:
            out[field] = F.coalesce(F.nullif(a, F.lit("")), b)
    return out


def validate_records(df: DataFrame) -> DataFrame:
    """Check and complete records before they are stored.

    Missing ``filename``, ``language`` or ``location`` stops the job with a
    message; other columns are cast, and defaults fill missing ones.
    """
    for field in ("filename", "language", "location"):
        if field not in df.columns:
            raise ValueError(f"missing required field: {field}")
    columns = []
    for field, kind in catalog.CHUNK_COLUMNS:
        if field in ("filename", "language", "location"):
            ok = F.col(field).isNotNull() & (F.col(field).cast("string") != "")
            columns.append(
                F.when(ok, F.col(field).cast(kind))
                .otherwise(F.raise_error(F.lit(f"missing required field: {field}")))
                .alias(field)
            )
            continue
        value = F.col(f"`{field}`").try_cast(kind) if field in df.columns else F.lit(None).cast(kind)
        if kind == "array<string>":
            if field in df.columns and not df.schema[field].dataType.simpleString().startswith("array"):
                raise ValueError(f"{field} must be a list")
            default = F.array().cast(kind)
        elif field == "source_name":
            default = F.lit("default")
        elif field in DETAIL_FIELDS:
            default = F.lit("[]")
        elif field in DEFAULTS:
            default = F.lit(DEFAULTS[field]).cast(kind)
        elif kind == "bigint":
            default = F.lit(0).cast(kind)
        elif kind == "string" and field != "embedding_model":
            default = F.lit("{}" if field == "metadata_json" else "")
        else:
            default = None
        columns.append((F.coalesce(value, default) if default is not None else value).alias(field))
    return df.select(*columns)
