"""Text to vector, per embedding model, behind a small registry.

The neural models are not part of this package.  Without a registered one, a
model is stood in for by feature hashing of the identifiers (Spark ML, inside
the JVM), salted with the model name so that vectors of different models are
not comparable - the same rule the search enforces.  Register a Pandas-UDF
based function to use a real model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog

# model name -> expression(text) giving array<float>
_MODELS: dict[str, Callable[[Column], Column]] = {}


def register_model(model: str, expression: Callable[[Column], Column]) -> None:
    """Use ``expression`` (for example a Pandas UDF call) for one model."""
    _MODELS[model] = expression


def unregister_model(model: str) -> None:
    _MODELS.pop(model, None)


def _hashed(df: DataFrame, text: str, model: Column, out: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}_][\p{L}\p{N}_]*"), F.lit(0))
    tokens = F.transform(words, lambda w: F.concat_ws(" ", model, w))
    counted = HashingTF(
        inputCol="_tokens", outputCol="_counts", numFeatures=catalog.VECTOR_DIMENSIONS
    ).transform(df.withColumn("_tokens", tokens))
    unit = Normalizer(inputCol="_counts", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_counts", "_unit")


def embed(df: DataFrame, text: str, model: str, out: str = "embedding") -> DataFrame:
    """Add vector column ``out`` of column ``text``; column ``model`` names the
    model of each row, so the label and the vector always agree."""
    name = F.col(model)
    hashed = _hashed(df, text, name, out)
    if not _MODELS:
        return hashed
    chosen = F.col(out)
    for registered, expression in _MODELS.items():
        own_text = F.when(name == registered, F.col(text))
        chosen = F.when(name == registered, expression(own_text)).otherwise(chosen)
    return hashed.withColumn(out, chosen)


def embed_text(spark: SparkSession, text: str, model: str) -> list[float]:
    """The vector of one request text, by the same path as the stored rows."""
    row = spark.createDataFrame([(text, model)], "text string, model string")
    return list(embed(row, "text", "model").select("embedding").first()[0])
