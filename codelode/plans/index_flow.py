"""Files to chunk rows: the whole indexing plan as one narrow projection.

Language, sizes, chunks, metadata and vectors are all computed inside the file's
own row; the plan has no shuffle, so it scales with the number of files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages
from codelode.functions.embedding import embed
from codelode.operators.analysis import analyze
from codelode.operators.chunking import HASKELL_REGEX, chunk_files
from codelode.operators.layout import RECOVERY_METHOD
from codelode.sources.files import scan


@dataclass(frozen=True)
class IndexConfig:
    """Options of an indexing run."""

    paths: list[str] = field(default_factory=list)
    include: list[str] | None = None
    exclude: list[str] | None = None
    use_gitignore: bool = True
    default_embedding: bool = False
    default_chunking: bool = False
    default_language_handler: bool = False
    chunk_factor_percent: int = 100
    poll_seconds: int = 60
    live: bool = True
    rescan: bool = False
    table: str = ""


def index_files(files: DataFrame, config: IndexConfig = IndexConfig(), with_vectors: bool = True) -> DataFrame:
    """Chunk table rows for ``filename, content, source_name`` rows.

    A ``language`` column, if present, is kept; otherwise the name decides.
    """
    if "language" not in files.columns:
        files = files.withColumn("language", languages.language_of(F.col("filename")))
    kept = files.select("filename", "language", "source_name", F.coalesce("content", F.lit("")).alias("content"))
    chunks = chunk_files(kept, config.default_chunking, config.chunk_factor_percent).drop("content")
    rows = chunks.withColumnRenamed("chunk_content", "code")
    rows = rows.withColumn("tree_sitter_chunking_error", F.col("chunking_method").isin(HASKELL_REGEX, RECOVERY_METHOD))
    rows = analyze(rows, basic=config.default_language_handler)
    model = (
        F.lit(catalog.MODEL_NAMES["fallback"])
        if config.default_embedding
        else languages.model_for_language(F.col("language"))
    )
    rows = rows.withColumn("embedding_model", model)
    if with_vectors:
        rows = embed(rows, "code", "embedding_model")
    else:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.selectExpr(*[f"cast(`{n}` AS {kind}) AS `{n}`" for n, kind in catalog.CHUNK_COLUMNS])


def index_paths(spark: SparkSession, config: IndexConfig) -> DataFrame:
    """Scan the configured folders and index what is found."""
    files = scan(spark, config.paths, config.include, config.exclude, config.use_gitignore)
    return index_files(files, config)
