"""One file row to many chunk rows.

Every chunker works inside the file's own row (arrays, then ``explode``), so
chunking needs no shuffle however many files or chunks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages
from codelode.functions.let import let, unnest
from codelode.functions.packing import merge_runs, pack, unique_names
from codelode.functions.sqltext import case, literal, name, one_of
from codelode.functions.symbols import bracket_errors, without_literals
from codelode.operators.layout import layout_chunks

# --- Fixed values: names of the chunking methods -----------------------------
SPLIT_RECURSIVELY = "split_recursively"
STRUCTURAL = "astchunk_library"
FIXED_LINES = "ast_fallback_unavailable"
HASKELL = "haskell_specialized_chunker"
HASKELL_REGEX = "rust_haskell_regex_fallback_python"

# Languages cut at the start of a top-level (or class-level) definition, with
# the line starts that begin one, strongest first.
_BRACE_STARTS = [
    r"^(?:export\s+|public\s+|private\s+|protected\s+|abstract\s+|static\s+|final\s+|default\s+|async\s+)*+"
    r"(?:class|interface|enum|function|namespace|record|struct|type)\b",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=",
    r"^(?:  |    |\t)(?:public|private|protected|static|async|@)",
    r"^$",
]
STRUCTURE_STARTS = {
    "Python": [r"^(?:class|def|async def|@)", r"^(?:    |\t)(?:def|async def|@)", r"^$"],
    **dict.fromkeys(["Java", "C#", "TypeScript", "JavaScript", "TSX"], _BRACE_STARTS),
}
CHUNK_TYPE = "array<struct<content:string,location:string,start:bigint,end:bigint,chunking_method:string>>"


def fixed_lines(code: Column, lines_per_chunk: int = catalog.FALLBACK_LINES) -> Column:
    """Chunks of a fixed number of lines; blank ones are left out, and the
    ordinal in the location counts the chunks that stay."""
    n = lines_per_chunk

    def cut(rows: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / n).cast("int")),
            lambda i: F.struct(
                F.array_join(F.slice(rows, i * n + 1, F.lit(n)), "\n").alias("content"),
                (i * n + 1).cast("bigint").alias("start"),
                F.least(i * n + n, F.size(rows)).cast("bigint").alias("end"),
            ),
        )

    pieces = F.filter(let(F.split(code, "\n", -1), cut), lambda c: c["content"].rlike(r"\S"))
    return _located(pieces, F.lit(FIXED_LINES))


def _located(pieces: Column, method: Column) -> Column:
    return F.transform(
        pieces,
        lambda c, i: F.struct(
            c["content"].alias("content"),
            F.concat(F.lit("line:"), c["start"], F.lit("#"), i).alias("location"),
            c["start"].cast("bigint").alias("start"),
            c["end"].cast("bigint").alias("end"),
            method.alias("chunking_method"),
        ),
    )


def _levels(segments: str, language: str, starts: dict[str, list[str]]) -> str:
    """SQL for the strength of the separator each segment starts with, 0 for
    none, by the patterns of the row's language.

    A segment that continues a cut line is never a separator.
    """

    def ranked(patterns: tuple[str, ...]) -> str:
        continued = f"i > 0 AND NOT endswith(element_at({segments}, greatest(i, 1)), '\\n')"
        ranks = [(f"s RLIKE {literal(p)}", str(len(patterns) - n)) for n, p in enumerate(patterns)]
        if len(patterns) > 1:  # most segments fit none, which one search tells; all patterns begin with ^
            ranks.insert(0, (f"NOT s RLIKE {literal('^(?:' + '|'.join(f'(?:{p[1:]})' for p in patterns) + ')')}", "0"))
        return f"transform({segments}, (s, i) -> {case([(continued, '0'), *ranks], '0')})"

    groups: dict[tuple, list[str]] = {}
    for member, patterns in starts.items():
        groups.setdefault(tuple(patterns), []).append(member)
    return case([(one_of(language, members), ranked(p)) for p, members in groups.items()], ranked((r"^$",)))


def _segments(code: Column, widest: Column) -> Column:
    """The whole text as lines with their line break; a line wider than the
    chunk limit is cut into pieces of that width.  Joined they are the text."""
    pattern = F.concat(F.lit(r"[^\n]{1,"), widest.cast("string"), F.lit("}\\n?|\\n"))
    return F.regexp_extract_all(code, pattern, F.lit(0))


def without_last_break(text: Column) -> Column:
    return F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)


def packed_chunks(
    df: DataFrame,
    out: str,
    levels: Column,
    limit: Column,
    least: Column,
    overlap: Column,
    every: Column,
    method: Column,
    solid: bool = False,
) -> DataFrame:
    """Add array column ``out``: chunks packed from the segments of ``_seg``."""
    seg = F.col("_seg")
    sizes = F.transform(seg, lambda s: F.length(F.translate(s, " \n\t", "") if solid else s))
    breaks = F.transform(seg, lambda s: s.endswith("\n").cast("int"))
    spans = pack(sizes, levels, breaks, limit, least, overlap, every)
    df = df.withColumn("_spans", spans)
    pieces = F.filter(
        F.transform(
            F.col("_spans"),
            lambda s: F.struct(
                let(F.array_join(F.slice(seg, s["first"], s["last"] - s["first"] + 1), ""), without_last_break).alias("content"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        ),
        lambda c: c["content"].rlike(r"\S"),
    )
    return df.withColumn(out, _located(pieces, method))


# Files that only their extension names take the separators of their kind.
SEPARATED_EXTENSIONS = {
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "ini": "Config", "cfg": "Config", "conf": "Config",
    "cmake": "CMake", "mk": "Makefile", "gradle": "Gradle",
}
# Text is cut into lines first, so an element begins where a line begins with its tag.
MAVEN_STARTS = [r"^<[A-Za-z]", r"^$"]


def chunk_files(df: DataFrame, default_chunking: bool = False, percent: int = 100, **columns: str) -> DataFrame:
    """Chunk rows of a file relation: the input columns plus ``chunk_content``,
    ``location``, ``start``, ``end`` and ``chunking_method``."""
    return _explode(chunk_arrays(df, default_chunking, percent, **columns).withColumnRenamed("chunks", "_chunks"))


def chunk_arrays(
    df: DataFrame,
    default_chunking: bool = False,
    percent: int = 100,
    content: str = "content",
    language: str = "language",
) -> DataFrame:
    """Add each file's chunks as the array column ``chunks``.

    With ``default_chunking`` every language uses the sized separator splitter
    (per-language sizes, overlap).  Otherwise structural languages and Haskell
    are cut at definitions and the rest into fixed line blocks; Haskell text is cut
    by its layout, and with many unmatched brackets into a chunk per declaration-like line.
    """
    lang = F.col(language)
    code = F.col(content)
    params = languages.chunk_params(lang, percent)
    structural = lang.isin(*STRUCTURE_STARTS)
    haskell = lang == "Haskell"
    if default_chunking:
        packs, damaged = F.lit(True), F.lit(False)
        limit, least = params["chunk_size"], params["min_chunk_size"]
        overlap, method = params["chunk_overlap"], F.lit(SPLIT_RECURSIVELY)
    else:
        packs = structural | haskell
        damaged = haskell & F.expr(f"{bracket_errors(without_literals(name(content), name(language)))} >= {catalog.PARSE_ERROR_LIMIT}")
        limit = F.lit(catalog.STRUCTURAL_BUDGET)
        least = F.when(haskell, catalog.HASKELL_MIN).otherwise(0)
        overlap = F.lit(0)
        method = F.when(damaged, HASKELL_REGEX).when(haskell, HASKELL).otherwise(STRUCTURAL)
    by_layout = F.lit(False) if default_chunking else haskell & ~damaged
    source = F.when(packs & ~by_layout, code)
    starts = {**catalog.LINE_SEPARATORS, **STRUCTURE_STARTS, "Maven": MAVEN_STARTS}
    starts |= {extension: starts[kind] for extension, kind in SEPARATED_EXTENSIONS.items()}
    levels = F.expr(_levels("_seg", name(language), starts))
    wide = df.withColumn("_seg", _segments(source, limit))
    wide = packed_chunks(
        wide, "_packed", levels, limit, least, overlap, damaged, method
    )
    chunks = F.when(packs, F.col("_packed"))
    if not default_chunking:
        wide = layout_chunks(wide.withColumn("_haskell", F.when(by_layout, code)), HASKELL, "_haskell", "_layout")
        shown = F.expr(f"cast(transform(_layout, c -> struct(c.content, c.location, c.start, c.end, c.chunking_method)) AS {CHUNK_TYPE})")
        chunks = F.when(by_layout, shown).when(packs, F.col("_packed")).otherwise(fixed_lines(code))
    return wide.withColumn("chunks", chunks).drop("_seg", "_spans", "_packed", "_haskell", "_layout")


def _explode(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "_chunks"]
    renamed = F.transform(
        "_chunks",
        lambda c: F.struct(
            c["content"].alias("chunk_content"), c["location"].alias("location"), c["start"].alias("start"),
            c["end"].alias("end"), c["chunking_method"].alias("chunking_method"),
        ),
    )
    return unnest(df, kept, renamed)


def haskell_regex_chunks(
    df: DataFrame, max_size: int = catalog.HASKELL_MAX, content: str = "content"
) -> DataFrame:
    """Chunks that begin at every declaration-like line, for text too damaged to
    treat as declarations; sizes ignore white space.  A bare line break is not a
    separator here."""
    wide = df.withColumn("_seg", _segments(F.col(content), F.lit(max_size)))
    wide = packed_chunks(
        wide, "_chunks",
        F.expr(_levels("_seg", "'Haskell'", {"Haskell": catalog.LINE_SEPARATORS["Haskell"]})),
        F.lit(max_size), F.lit(0), F.lit(0), F.lit(True), F.lit(HASKELL_REGEX), solid=True,
    )
    return _explode(wide.drop("_seg", "_spans"))


def with_unique_locations(df: DataFrame, chunks: str = "chunks", joiner: str = "#") -> DataFrame:
    """The array column's locations made unique within its row (file)."""
    names = unique_names(F.col(f"{chunks}.location"), joiner)
    return (
        df.withColumn("_names", names)
        .withColumn(
            chunks,
            F.zip_with(chunks, "_names", lambda c, n: c.withField("location", n)),
        )
        .drop("_names")
    )


def with_overlap(chunks: Column, lines: Column, overlap: int) -> Column:
    """Each chunk with up to ``overlap`` of the file's lines before and after it.

    Neighbours are elements of the same array, so no window is needed.
    """

    def widen(rows: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            before = F.slice(
                rows,
                F.greatest(c["start"].cast("int") - overlap, F.lit(1)),
                F.least(c["start"].cast("int") - 1, F.lit(overlap)),
            )
            after = F.slice(rows, c["end"].cast("int") + 1, F.lit(overlap))
            parts = F.array(
                F.when((i > 0) & (F.size(before) > 0), F.array_join(before, "\n")),
                c["content"],
                F.when((i < F.size(chunks) - 1) & (F.size(after) > 0), F.array_join(after, "\n")),
            )
            return c.withField("content", F.array_join(parts, "\n"))

        return F.transform(chunks, one)

    return let(lines, widen)


def with_header(content: Column, path: Column, start: Column, end: Column, kind: Column, method: Column) -> Column:
    """The chunk text below a comment line that says where it comes from."""
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("File: "), path)),
        F.concat(F.lit("Lines: "), start, F.lit("-"), end),
        F.concat(F.lit("Node type: "), F.coalesce(kind, F.lit("unknown"))),
        F.when(F.coalesce(method, F.lit("")) != "", F.concat(F.lit("Method: "), method)),
    )
    return F.concat(F.lit("-- "), parts, F.lit("\n"), content)


def merge_adjacent(df: DataFrame, chunks: str, max_size: int) -> DataFrame:
    """Touching neighbours of one category joined while they fit ``max_size``.

    ``chunks`` is an array of structs with content, start, end and category.
    """
    c = F.col(chunks)
    runs = merge_runs(
        F.transform(c, lambda x: F.length(x["content"])),
        F.transform(c, lambda x: x["start"].cast("bigint")),
        F.transform(c, lambda x: x["end"].cast("bigint")),
        F.transform(c, lambda x: x["category"]),
        F.lit(max_size),
    )
    joined = F.transform(
        F.col("_runs"),
        lambda r: F.struct(
            F.array_join(
                F.transform(F.slice(c, r["first"], r["last"] - r["first"] + 1), lambda x: x["content"]), "\n"
            ).alias("content"),
            F.element_at(c, r["first"])["start"].alias("start"),
            F.element_at(c, r["last"])["end"].alias("end"),
            F.element_at(c, r["first"])["category"].alias("category"),
        ),
    )
    return df.withColumn("_runs", runs).withColumn(chunks, joined).drop("_runs")
