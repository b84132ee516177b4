"""Search results as text.  Formatting is a projection; rows come one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RAW = ("code", "metadata_json")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per result in column ``json``, with the keys of
    ``metadata_json`` that are not columns promoted beside them.  NULLs are left out."""
    if "metadata_json" not in df.columns:
        return df.select(F.to_json(F.struct("*")).alias("json"))
    # Keys of the stored object that a column already has are dropped; what is
    # left is spliced in before the closing brace of the row object.
    stored = F.from_json("metadata_json", "map<string,string>")
    taken = F.array(*[F.lit(c) for c in df.columns])
    extra = F.map_filter(stored, lambda k, v: ~F.array_contains(taken, k) & v.isNotNull())
    parts = F.transform(
        F.map_entries(extra),
        lambda e: F.concat(
            F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), json_value(e["value"])
        ),
    )
    base = F.to_json(F.struct("*"))
    joined = F.array_join(parts, ",")
    spliced = F.when(F.coalesce(joined, F.lit("")) == "", base).otherwise(
        F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(","), joined, F.lit("}"))
    )
    return df.select(spliced.alias("json"))


def json_value(text: Column) -> Column:
    """A map value as JSON: JSON text stays, other text is quoted."""
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    is_json = text.rlike(r"^(?:-?[0-9]+(?:\.[0-9]+)?|true|false|[\[{].*[\]}])$")
    return F.when(is_json & F.try_parse_json(text).isNotNull(), text).otherwise(quoted)


def readable_lines(df: DataFrame) -> DataFrame:
    """Column ``line``: the headline of each result, like
    ``[0.873] (hybrid_combined) src/a.py (Python) (L1-L9)``."""
    source = F.when(
        F.coalesce(F.col("source_name"), F.lit("files")) != "files", F.concat(F.lit(" ["), "source_name", F.lit("]"))
    ).otherwise("")
    return df.withColumn(
        "line",
        F.concat(
            F.lit("["), F.format_string("%.3f", F.col("score")), F.lit("] ("), F.col("score_type"), F.lit(") "),
            F.col("filename"), source, F.lit(" ("), F.col("language"), F.lit(") (L"),
            F.col("start"), F.lit("-L"), F.col("end"), F.lit(")"),
        ),
    )


def _listed(df: DataFrame, label: str, column: str) -> Column:
    """``label: a, b`` for a list that has entries, else NULL."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    return F.when(F.size(column) > 0, F.concat(F.lit(f"{label}: "), F.array_join(column, ", ")))


def _marked(df: DataFrame, label: Column, column: str, condition: Column) -> Column:
    return F.when(condition, label) if column in df.columns else F.lit(None).cast("string")


def readable_blocks(df: DataFrame) -> DataFrame:
    """Column ``block``: headline, what is known about Python rows, and the code."""
    lists = [("Functions", "functions"), ("Classes", "classes"), ("Imports", "imports"), ("Decorators", "decorators")]
    facts = F.concat_ws(" | ", *[_listed(df, *pair) for pair in lists])
    marks = F.concat_ws(
        ", ",
        _marked(df, F.lit("typed"), "has_type_hints", F.col("has_type_hints")),
        _marked(df, F.lit("async"), "has_async", F.col("has_async")),
        _marked(df, F.format_string("complex(%s)", F.col("complexity_score")), "complexity_score", F.col("complexity_score") > 10),
    )
    python = F.col("language") == "Python"
    parts = [
        F.col("line"),
        F.when(python & (facts != ""), F.concat(F.lit("   📝 "), facts)),
        F.when(python & (marks != ""), F.concat(F.lit("   🏷️  "), marks)),
        F.concat(F.lit("   "), F.coalesce("code", F.lit("None"))),
        F.lit("   ---"),
    ]
    return readable_lines(df).withColumn("block", F.concat_ws("\n", *parts))


def readable(df: DataFrame) -> str:
    """A finished, limited result as text for people."""
    blocks = [r.block for r in readable_blocks(df).select("block").collect()]
    if not blocks:
        return "No results found."
    numbered = [f"{number}. {block}" for number, block in enumerate(blocks, 1)]
    return "\n".join([f"📊 Found {len(blocks)} results:\n", *numbered])


def pseudo_json_blocks(df: DataFrame) -> DataFrame:
    """Column ``block``: one JSON-like object per result; long texts stand in triple quotes, NULLs are left out."""

    def value(column: str) -> Column:
        if column in _RAW:
            return F.concat(F.lit('"""'), F.col(column), F.lit('"""'))
        return F.regexp_replace(F.to_json(F.array(F.col(f"`{column}`"))), r"^\[|\]$", "")

    fields = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f'      "{c}": '), value(c))) for c in df.columns]
    return df.select(F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }")).alias("block"))


def pseudo_json(df: DataFrame) -> str:
    """A finished, limited result as JSON-like text."""
    blocks = [r.block for r in pseudo_json_blocks(df).collect()]
    return "[\n" + ",\n".join(blocks) + "\n]" if blocks else "[]"
