"""Names a query may use for columns."""

from __future__ import annotations

from codelode import catalog

COLUMN_NAMES = [name for name, _ in catalog.CHUNK_COLUMNS]


def resolve_field(name: str) -> str:
    """Column for a user's field name, or ValueError listing what is valid."""
    plain = name.replace("_", "").replace("-", "")
    if plain.isalnum():
        if name in COLUMN_NAMES:
            return name
        if name.lower() in catalog.FIELD_ALIASES:
            return catalog.FIELD_ALIASES[name.lower()]
    valid = ", ".join(sorted(COLUMN_NAMES))
    aliases = ", ".join(sorted(catalog.FIELD_ALIASES))
    raise ValueError(f"Invalid field '{name}'. Valid fields: {valid}. Aliases: {aliases}")


def field_kind(df, name: str) -> str:
    """Type of a column of this relation."""
    if name not in df.columns:
        raise ValueError(f"Invalid field '{name}'. This table has: {', '.join(df.columns)}")
    return df.schema[name].dataType.simpleString()


# --- Fixed values: spellings of truth values ---------------------------------
TRUE_WORDS = {"true", "t", "yes", "y", "on", "1"}
FALSE_WORDS = {"false", "f", "no", "n", "off", "0"}


def typed_value(value, kind: str, field: str):
    """A query's text as a value of the column's type."""
    text = str(value).strip()
    try:
        if kind == "boolean":
            word = text.lower()
            if word not in TRUE_WORDS | FALSE_WORDS:
                raise ValueError
            return word in TRUE_WORDS
        if kind in ("tinyint", "smallint", "int", "bigint"):
            return int(text)
        if kind in ("float", "double"):
            return float(text)
    except ValueError:
        raise ValueError(f"'{value}' is not a valid {kind} value for field '{field}'") from None
    if kind == "array<float>":
        raise ValueError(f"field '{field}' holds vectors and cannot be compared with text")
    return value
