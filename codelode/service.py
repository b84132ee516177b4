"""The search service as one object over a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog, report
from codelode.functions import embedding, languages
from codelode.operators import search
from codelode.operators.analysis import analyze
from codelode.plans.builder import Query
from codelode.sources.store import ChunkStore


class SearchSession:
    """Searches, tools and resources over one chunk table.

    Every search returns a lazy DataFrame; turn it into text with ``report``.
    """

    def __init__(
        self,
        table: DataFrame,
        includes: list[str] | None = None,
        excludes: list[str] | None = None,
        post_filter: bool = False,
        name: str = "chunks",
    ):
        self.table, self.name = table, name
        self.includes, self.excludes = includes, excludes or []
        self.post_filter = post_filter

    @property
    def spark(self) -> SparkSession:
        return self.table.sparkSession

    def _rows(self) -> DataFrame:
        if self.includes is None or self.post_filter:
            return self.table
        return search.path_filter(self.table, self.includes, self.excludes)

    def _visible(self, result: DataFrame) -> DataFrame:
        if self.includes is not None and self.post_filter:
            return search.path_filter(result, self.includes, self.excludes)
        return result

    def search(
        self,
        vector_query: str | list[float] | None = None,
        keyword_query: str | None = None,
        top_k: int = catalog.DEFAULT_TOP_K,
        vector_weight: float = catalog.DEFAULT_VECTOR_WEIGHT,
        keyword_weight: float = catalog.DEFAULT_KEYWORD_WEIGHT,
        language: str | None = None,
        embedding_model: str | None = None,
    ) -> DataFrame:
        """Hybrid, vector or keyword search, by which queries are given.

        A text query needs ``language`` or ``embedding_model`` to choose the
        vectors it is compared with; the model wins if both are given.
        """
        keywords = keyword_query if keyword_query and keyword_query.strip() else None
        rows = self._rows()
        if vector_query is None or (isinstance(vector_query, str) and not vector_query.strip()):
            if keywords is None:
                return search.keyword_search(rows.limit(0))
            return self._visible(search.keyword_search(rows, keywords, top_k))
        model = embedding_model or (languages.model_for_language_name(language) if language else None)
        if isinstance(vector_query, str):
            if model is None:
                raise ValueError("a text query needs language or embedding_model")
            vector = embedding.embed_text(self.spark, vector_query, model)
        else:
            vector = [float(x) for x in vector_query]
        if keywords is None:
            return self._visible(search.vector_search(rows, vector, top_k, model))
        return self._visible(
            search.hybrid_search(rows, vector, keywords, top_k, vector_weight, keyword_weight, model)
        )

    def search_late(self, *args, **options) -> DataFrame:
        """The same search in two reads: keys and scores first, then the k rows.

        Runs the first part at once.  Worth it on large tables, where the code
        text of all other rows is then never read.
        """
        return search.late_rows(self.table, self.search(*args, **options))

    def hybrid(self, vector_query, keyword_query: str, **options) -> DataFrame:
        return self.search(vector_query, keyword_query, **options)

    def vector(self, query, top_k: int = catalog.DEFAULT_TOP_K, language=None, embedding_model=None) -> DataFrame:
        """Similarity only: weights 1 and 0."""
        return self.search(
            query, None, top_k, 1.0, 0.0, language=language, embedding_model=embedding_model
        )

    def keyword(self, query: str, top_k: int = catalog.DEFAULT_TOP_K) -> DataFrame:
        """Keywords only: weights 0 and 1."""
        return self.search(None, query, top_k, 0.0, 1.0)

    def run(self, query: Query) -> DataFrame:
        """A built query over the visible rows."""
        return self._visible(query.run(self._rows()))

    def analyze(self, code: str, file_path: str, language: str | None = None) -> dict:
        """Metadata of one piece of text."""
        row = self.spark.createDataFrame([(code, file_path)], "code string, filename string")
        detected = F.lit(language) if language else languages.language_of(F.col("filename"))
        found = analyze(row.withColumn("language", languages.display_name(detected)))
        return found.first().asDict(True)

    def embeddings(self, text: str, embedding_model: str = catalog.MODEL_NAMES["fallback"]) -> dict:
        vector = embedding.embed_text(self.spark, text, embedding_model)
        return {"text": text, "embedding": vector, "dimensions": len(vector)}

    def help_keyword_syntax(self) -> dict:
        """The keyword language, from the columns this table really has."""
        kinds = {f.name: f.dataType.simpleString() for f in self.table.schema}
        return {
            "terms": {
                "equals": "column:text, quoted if it has blanks",
                "present": "exists(column)",
                "holds": "value_contains(column, text)",
                "words": "anything else is looked up in the code",
            },
            "boolean_logic": "terms side by side and AND mean both; OR means either and binds weaker; brackets group",
            "columns": kinds,
            "short_names": catalog.FIELD_ALIASES,
        }

    def stats(self) -> dict:
        return {"table_name": self.name, "total_records": self.table.count()}

    def config(self) -> dict:
        return {
            "table_name": self.name,
            "embedding_models": catalog.MODEL_NAMES,
            "default_weights": {
                "vector_weight": catalog.DEFAULT_VECTOR_WEIGHT,
                "keyword_weight": catalog.DEFAULT_KEYWORD_WEIGHT,
            },
            "default_top_k": catalog.DEFAULT_TOP_K,
        }

    def schema(self) -> dict:
        return {
            "table_name": self.name,
            "columns": [
                {"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable}
                for f in self.table.schema
            ],
        }

    def examples(self) -> dict:
        """One query of each form over columns of this table."""
        kinds = {f.name: f.dataType.simpleString() for f in self.table.schema}
        flags = [n for n, kind in kinds.items() if kind == "boolean"]
        lists = [n for n in ("functions", "classes", "imports") if n in kinds]
        texts = [n for n in ("filename", "language") if n in kinds]
        return {
            "equals": [f"{n}:true" for n in flags] + [f"{n}:x" for n in texts],
            "present": [f"exists({n})" for n in lists],
            "holds": [f'value_contains({n}, "x")' for n in [*lists, *texts]],
            "together": [f"{a}:true OR exists({b})" for a, b in zip(flags, lists, strict=False)],
        }

    def languages(self, limit: int | None = None) -> DataFrame:
        found = self.table.select("language").distinct().orderBy("language")
        return found if limit is None else found.limit(limit)

    def readable(self, result: DataFrame) -> str:
        return report.readable(result)


_BACKENDS = {"spark": lambda spark, folder: SearchSession(ChunkStore(spark, folder).table(), name=folder)}


def register_backend(name: str, opener) -> None:
    """Make another way to open a table available under a name."""
    _BACKENDS[name] = opener


def list_backends() -> list[str]:
    return sorted(_BACKENDS)


def open_session(spark: SparkSession, folder: str, backend: str = "spark") -> SearchSession:
    if backend not in _BACKENDS:
        raise ValueError(f"unknown backend '{backend}'. Known: {', '.join(list_backends())}")
    return _BACKENDS[backend](spark, folder)
