"""Keyword, vector and hybrid search as lazy DataFrames.

Every search is a filter, at most one score column, and ``orderBy`` + ``limit``,
which Spark runs as one pass with a bounded top-k per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions.vectors import cosine_distance
from codelode.operators import block_search
from codelode.operators.keyword import keyword_filter
from codelode.sources import globs

# --- Fixed values: how a score came about ------------------------------------
VECTOR, KEYWORD, HYBRID, EXACT = (
    "vector_similarity", "keyword_match", "hybrid_combined", "exact_match",
)
_TIES = ["filename", "start", "location", "source_name"]


def selectable(df: DataFrame) -> list[str]:
    """Columns a result shows: the table's known ones, without the vector."""
    known = [n for n, _ in catalog.CHUNK_COLUMNS if n != "embedding"]
    return [n for n in known if n in df.columns]


def missing_columns(df: DataFrame) -> list[str]:
    return sorted({n for n, _ in catalog.CHUNK_COLUMNS} - set(df.columns))


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(f"`{n}`").asc_nulls_last() for n in _TIES if n in df.columns]


def _of_model(df: DataFrame, model: str | None) -> DataFrame:
    """Only vectors of one model; vectors of different models never compare."""
    return df.filter(F.col("embedding_model") == model) if model else df


def _result(df: DataFrame, score: Column, kind: str) -> DataFrame:
    columns = selectable(df)
    extra = [F.col("distance")] if "distance" in df.columns else []
    return df.select(*[F.col(f"`{c}`") for c in columns], *extra, score.alias("score"), F.lit(kind).alias("score_type"))


def keyword_search(df: DataFrame, query: str | None = None, top_k: int = catalog.DEFAULT_TOP_K) -> DataFrame:
    """Matching rows by file name and line; every score is 1."""
    found = keyword_filter(df, query).withColumn("distance", F.lit(0.0))
    return _result(found, F.lit(1.0), KEYWORD).orderBy(*_ties(df)).limit(top_k)


def with_distance(df: DataFrame, query_vector: list[float], embedding_model: str | None = None) -> DataFrame:
    """Rows of the model with their distance, NULL where a row has no usable vector.

    A filter on the distance here would make Spark compute it twice, so callers
    drop those rows after their limit: they are ordered last.
    """
    comparable = _of_model(df, embedding_model)
    return comparable.withColumn("distance", cosine_distance(F.col("embedding"), query_vector))


def vector_search(
    df: DataFrame,
    query_vector: list[float],
    top_k: int = catalog.DEFAULT_TOP_K,
    embedding_model: str | None = None,
) -> DataFrame:
    """Nearest rows by cosine distance."""
    scored = with_distance(df, query_vector, embedding_model)
    result = _result(scored, F.lit(1.0) - F.col("distance"), VECTOR)
    return result.orderBy(F.col("distance").asc_nulls_last(), *_ties(df)).limit(top_k).filter(F.col("distance").isNotNull())


def multi_query_search(
    df: DataFrame,
    requests: DataFrame,
    top_k: int = catalog.DEFAULT_TOP_K,
    embedding_model: str | None = None,
) -> DataFrame:
    """The nearest rows of many requests (query_id, embedding), both sides in blocks."""
    keys = [n for n in _TIES if n in df.columns]
    rows = _of_model(df, embedding_model).select(*keys, "embedding")
    return block_search.multi_query_search(rows, requests, top_k, keys, _ties(df))


def legacy_vector_search(df: DataFrame, query_vector: list[float], top_k: int = catalog.LEGACY_TOP_K) -> DataFrame:
    """The older search: five rows of any model, seven columns."""
    columns = ["filename", "language", "code", "start", "end", "source_name", "score"]
    return vector_search(df, query_vector, top_k).select(*columns)


def hybrid_search(
    df: DataFrame,
    query_vector: list[float],
    keyword_query: str | None = None,
    top_k: int = catalog.DEFAULT_TOP_K,
    vector_weight: float = catalog.DEFAULT_VECTOR_WEIGHT,
    keyword_weight: float = catalog.DEFAULT_KEYWORD_WEIGHT,
    embedding_model: str | None = None,
) -> DataFrame:
    """Keyword matches ranked by ``similarity * vector_weight + keyword_weight``.

    The keyword weight is the same for every row that passed the filter, so it
    shifts the score without changing the order.
    """
    scored = with_distance(keyword_filter(df, keyword_query), query_vector, embedding_model)
    score = (F.lit(1.0) - F.col("distance")) * vector_weight + F.lit(float(keyword_weight))
    return (
        _result(scored, score, HYBRID).orderBy(F.col("score").desc_nulls_last(), *_ties(df)).limit(top_k)
        .filter(F.col("score").isNotNull())
    )


def path_filter(
    df: DataFrame, includes: list[str], excludes: list[str], filename: str = "filename"
) -> DataFrame:
    """Rows whose path the current patterns allow.

    Before a search it narrows the table; after one it may leave fewer than k.
    """
    return df.filter(globs.path_matches(F.col(filename), includes, excludes))


def complete_result(df: DataFrame) -> DataFrame:
    """Result rows with defaults: a source, a location, and the short names."""
    span = F.when(
        (F.coalesce(F.col("start"), F.lit(0)) != 0) & (F.coalesce(F.col("end"), F.lit(0)) != 0),
        F.concat(F.lit(":"), F.col("start"), F.lit("-"), F.col("end")),
    ).otherwise("")
    place = F.concat(F.col("filename"), span)
    source = F.col("source_name") if "source_name" in df.columns else F.lit(None).cast("string")
    location = F.coalesce(F.col("location"), place) if "location" in df.columns else place
    out = df.withColumns({"source_name": F.coalesce(source, F.lit("default")), "location": location})
    if "complexity_score" in df.columns:
        out = out.withColumn("complexity", F.col("complexity_score"))
    return out


def late_rows(df: DataFrame, top: DataFrame) -> DataFrame:
    """Fetch the wide columns of a finished top-k in a second, narrow read.

    The k keys come to the driver (k is the request's limit) and go back as
    literals, so Parquet skips row groups by file name instead of carrying the
    code text of every row through the sort.
    """
    keys = [c for c in catalog.CHUNK_KEY if c in df.columns]
    extra = [c for c in ("distance", "score", "score_type") if c in top.columns]
    ranked = top.select(*keys, *extra)
    found = ranked.collect()
    columns = selectable(df)
    ranked = df.sparkSession.createDataFrame(found, ranked.schema).select(*[F.col(k).alias(f"_{k}") for k in keys], *extra)
    narrow = df.filter(F.col("filename").isin(sorted({r.filename for r in found if r.filename is not None})) | F.col("filename").isNull())
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"_{k}")) for k in keys])
    rows = narrow.select(*[F.col(f"`{c}`") for c in columns]).join(F.broadcast(ranked), same)
    return rows.select(*[F.col(f"`{c}`") for c in columns], *extra).orderBy(F.col("score").desc_nulls_last(), *_ties(df))
