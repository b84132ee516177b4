"""Language detection, chunk sizes and model routing as Column expressions.

The lookups are constant maps, folded into the projection: no join, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import sqltext


def constant_map(values: dict) -> Column:
    return F.expr(sqltext.constant_map(values))


def lookup(values: dict, key: Column) -> Column:
    """Value for a key, NULL when the key is unknown."""
    return F.try_element_at(constant_map(values), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none or a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """Display language of a file name.

    Well-known file names come first, then the extension; an unknown extension
    is returned without its dot, no extension gives ``Unknown``.
    """
    name = basename(path)
    lower = F.lower(name)
    tests = {
        "equals_nocase": lambda t: lower == t,
        "starts_nocase": lambda t: lower.startswith(t),
        "contains_nocase": lambda t: lower.contains(t),
        "starts": lambda t: name.startswith(t),
        "equals": lambda t: name == t,
    }
    kind, text, language = catalog.BASENAME_LANGUAGE[0]
    rule = F.when(tests[kind](text), F.lit(language))
    for kind, text, language in catalog.BASENAME_LANGUAGE[1:]:
        rule = rule.when(tests[kind](text), F.lit(language))
    ext = extension(path)
    return rule.otherwise(
        F.coalesce(
            lookup(catalog.EXTENSION_LANGUAGE, ext),
            F.nullif(F.substr(ext, F.lit(2)), F.lit("")),
            F.lit("Unknown"),
        )
    )


def internal_name(language: Column) -> Column:
    """Internal language name; unlisted languages are lower-cased."""
    return F.coalesce(lookup(catalog.INTERNAL_LANGUAGE, language), F.lower(language))


def display_name(internal: Column) -> Column:
    """Display name of an internal one; unlisted names stay as they are."""
    reverse = {v: k for k, v in catalog.INTERNAL_LANGUAGE.items()}
    return F.coalesce(lookup(reverse, internal), internal)


def scaled_params(percent: int = 100) -> dict[str, tuple[int, int, int, int]]:
    """Chunk sizes for every language, scaled; the maximum is at least twice
    the unscaled size once a scale is applied."""
    if percent == 100:
        return {k: (s, mn, ov, mx or 2 * s) for k, (s, mn, ov, mx) in catalog.CHUNK_PARAMS.items()}
    return {
        k: (
            s * percent // 100,
            mn * percent // 100,
            ov * percent // 100,
            max(mx * percent // 100, 2 * s),
        )
        for k, (s, mn, ov, mx) in catalog.CHUNK_PARAMS.items()
    }


PARAM_FIELDS = ["chunk_size", "min_chunk_size", "chunk_overlap", "max_chunk_size"]


def chunk_params(language: Column, percent: int = 100) -> Column:
    """Struct of chunk sizes for a language, the default where unlisted."""
    table = scaled_params(percent)
    default = table[catalog.DEFAULT_CHUNK_KEY]

    def field(i: int) -> Column:
        return F.coalesce(
            lookup({k: v[i] for k, v in table.items()}, language), F.lit(default[i])
        ).alias(PARAM_FIELDS[i])

    return F.struct(*[field(i) for i in range(4)])


def params_table(spark: SparkSession, percent: int = 100) -> DataFrame:
    """The chunk sizes as a small dimension table (26 rows)."""
    rows = [(k, *v) for k, v in scaled_params(percent).items()]
    return spark.createDataFrame(rows, "language string, " + ", ".join(f"{f} int" for f in PARAM_FIELDS))


def model_group(language: Column) -> Column:
    """``graphcodebert``, ``unixcoder`` or ``fallback``."""
    lower = F.lower(language)
    return (
        F.when(lower.isin(catalog.MODEL_GROUPS["graphcodebert"]), "graphcodebert")
        .when(lower.isin(catalog.MODEL_GROUPS["unixcoder"]), "unixcoder")
        .otherwise("fallback")
    )


def model_name(group: Column) -> Column:
    return F.coalesce(
        lookup(catalog.MODEL_NAMES, group), F.lit(catalog.MODEL_NAMES["fallback"])
    )


def model_for_language(language: Column) -> Column:
    return model_name(model_group(language))


def model_for_language_name(language: str) -> str:
    """The same routing for one language given by a search request."""
    lower = language.lower()
    for group, members in catalog.MODEL_GROUPS.items():
        if lower in members:
            return catalog.MODEL_NAMES[group]
    return catalog.MODEL_NAMES["fallback"]


def select_model(language: Column, path: Column | None = None, force: str | None = None) -> Column:
    """Selector that also understands short spellings and, without a language,
    the file extension; a forced model wins."""
    if force:
        return F.lit(force)
    named = F.nullif(F.trim(F.lower(language)), F.lit(""))
    if path is not None:
        named = F.coalesce(named, internal_name(language_of(path)))
    plain = F.coalesce(lookup(catalog.SELECTOR_ALIASES, named), named)
    routed = F.when(~plain.isin(catalog.SELECTOR_UNLISTED), model_for_language(plain))
    return F.coalesce(routed, F.lit(catalog.MODEL_NAMES["fallback"]))


def model_args(model: str) -> dict:
    """Loader options of a model."""
    return {"trust_remote_code": True} if model.startswith("microsoft/") else {}


def supported_languages(spark: SparkSession) -> DataFrame:
    """Languages and extensions that are routed to a specialised model."""
    rows = [
        (ext, lang, model_for_language_name(lang)) for ext, lang in catalog.EXTENSION_LANGUAGE.items()
    ]
    return spark.createDataFrame(rows, "extension string, language string, model string")


def is_haskell(language: Column) -> Column:
    return language == "Haskell"


def file_method(chunk_method: Column, whole_file_method: Column) -> Column:
    """The chunk's own method, or the file's where the chunk has none."""
    return F.when(chunk_method == "unknown_chunking", whole_file_method).otherwise(chunk_method)
