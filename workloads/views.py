"""The given tables seen as files and chunk rows.

``documents`` are text files, ``pages`` HTML files; ``embeddings`` holds the
vectors of some documents.  ``part`` gives source files: each part becomes one
file of program text in one of nine languages, with a function per unit of its
size, so analyzers and chunkers meet real declarations and the amount of text
grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.let import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the chunk table's column names, without vectors."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), "doc_id", F.lit("."), "lang").alias("filename"),
        F.lit("line:1#0").alias("location"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("language"),
        F.col("text").alias("code"),
        F.lit(1).cast("bigint").alias("start"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("end"),
        F.col("n_chars").cast("bigint").alias("char_count"),
    )


DOCUMENTS_SQL = """
  SELECT doc_id, 'doc_' || doc_id || '.' || lang AS filename, 'line:1#0' AS location,
         source AS source_name, lang AS language, text AS code, 1::BIGINT AS start,
         (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS "end",
         n_chars AS char_count
  FROM documents"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vectors; documents without one have NULL."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        "embedding",
        F.concat(F.lit("model_"), "label").alias("embedding_model"),
    )
    return document_rows(spark, sf_dir).join(vectors, "doc_id", "left")


CHUNKS_SQL = f"""
  SELECT d.*, e.embedding, 'model_' || e.label AS embedding_model
  FROM ({DOCUMENTS_SQL}) d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, used as the request's vector."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit("."), "lang").alias("filename"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("language"),
        "doc_id",
    )


# Program text per language: (folder/extension, head, body per function, tail).
# {id} part number, {name} part name, {size} part size, {i} 1 .. size.
SOURCE_TEXT = {
    "Python": (
        "py",
        'import os\nfrom shop.catalog import Item\n\nLIMIT = {size}\n\n@register\nclass Part{id}(Item):\n    """{name}"""\n\n    def label(self) -> str:\n        return os.path.join("{name}", "x")\n\n',
        "def compute_{id}_{i}(qty, rate=1):\n    if qty > {i}:\n        return qty * rate\n    for step in range({i}):\n        qty += step\n    return qty\n\n",
        "async def main_{id}():\n    return compute_{id}_1(2)\n",
    ),
    "Haskell": (
        "hs",
        "module Part{id} where\n\nimport qualified Data.Map as Map\nimport Shop.Catalog\n\ndata Kind{id} = Small | Large\n\nclass Shape{id} a where\n  area :: a -> Int\n\n-- {name}: note :: not code\n\n",
        "compute_{id}_{i} :: Int -> Int\ncompute_{id}_{i} qty\n  | qty > {i} = qty\n  | otherwise = case qty of\n      0 -> {i}\n      n -> n + 1\n\n",
        "main_{id} :: IO ()\nmain_{id} = do\n  print (compute_{id}_1 2)\n",
    ),
    "C": (
        "c",
        '#include <stdio.h>\n\nstruct Part{id} {\n    int size;\n};\n\nenum Kind{id} { SMALL, LARGE };\n\n/* {name}: int hidden(int a) { } */\n\n',
        "int compute_{id}_{i}(int qty, int rate) {\n    if (qty > {i}) {\n        return qty * rate;\n    }\n    for (int s = 0; s < {i}; s++) {\n        qty += s;\n    }\n    return qty;\n}\n\n",
        'int main_{id}(void) {\n    printf("{name} // %d", compute_{id}_1(2, 1));\n    return 0;\n}\n',
    ),
    "C++": (
        "cpp",
        "#include <vector>\n\nnamespace shop_{id} {\n\nclass Part{id} : public Item {\npublic:\n    int label() const {\n        return {size};\n    }\n};\n\n",
        "int compute_{id}_{i}(int qty) {\n    while (qty > {i}) {\n        qty--;\n    }\n    return qty;\n}\n\n",
        "}\n",
    ),
    "Rust": (
        "rs",
        "use shop::catalog;\n\npub struct Part{id} {\n    size: i32,\n}\n\ntrait Shape{id} {\n    fn area(&self) -> i32;\n}\n\nimpl Shape{id} for Part{id} {\n    fn area(&self) -> i32 {\n        self.size\n    }\n}\n\n",
        "pub fn compute_{id}_{i}(qty: i32) -> i32 {\n    match qty {\n        {i} => 1,\n        _ => qty,\n    }\n}\n\n",
        "async fn main_{id}() {\n    compute_{id}_1(2);\n}\n",
    ),
    "Kotlin": (
        "kt",
        "package shop.catalog\n\ndata class Part{id}(val size: Int)\n\ninterface Shape{id}\n\n// fun hidden() {name}\n",
        "fun compute_{id}_{i}(qty: Int): Int {\n    if (qty > {i}) {\n        return qty\n    }\n    return {i}\n}\n\n",
        "suspend fun main_{id}() {\n    compute_{id}_1(2)\n}\n",
    ),
    "Java": (
        "java",
        "package shop.catalog;\n\nimport java.util.List;\n\npublic class Part{id} extends Item {\n    // class Hidden {name}\n\n    public Part{id}(int size) {\n        super(size);\n    }\n\n",
        "    public static int compute_{id}_{i}(int qty) {\n        if (qty > {i}) {\n            return step(qty);\n        } else if (qty == 0) {\n            return {i};\n        }\n        return qty;\n    }\n\n",
        "}\n",
    ),
    "TypeScript": (
        "ts",
        'import { Item } from "./item";\n\nexport interface Shape{id} {\n    size: number;\n}\n\ntype Id{id} = string;\n\nexport class Part{id} extends Item {\n    label(): string {\n        return "{name}";\n    }\n}\n\n',
        "export function compute_{id}_{i}(qty: number): number {\n    if (qty > {i}) {\n        return qty;\n    }\n    return {i};\n}\n\n",
        "const main_{id} = async (n: number): Promise<number> => compute_{id}_1(n);\n",
    ),
    "JavaScript": (
        "js",
        'import { Item } from "./item.js";\n\nclass Part{id} extends Item {\n    label() {\n        return "{name}";\n    }\n}\n\n',
        "function compute_{id}_{i}(qty) {\n    try {\n        return qty > {i} ? 1 : qty;\n    } catch (e) {\n        return {i};\n    }\n}\n\n",
        "export const main_{id} = (n) => compute_{id}_1(n);\n",
    ),
}
LANGUAGES = list(SOURCE_TEXT)
# Large parts of Python files end in text that does not parse.
DAMAGED_FROM = 40
DAMAGE = "def broken_{id}(:\n"


def _fill(text: Column) -> Column:
    values = {"{id}": F.col("p_partkey"), "{name}": F.col("p_name"), "{size}": F.col("p_size")}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return text


PARTS_PER_TASK = 1024


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filename, content, source_name, language, p_partkey, p_size`` per part."""
    number = F.pmod(F.col("p_partkey"), F.lit(len(LANGUAGES)))
    language = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (number + 1).cast("int"))

    def pick(position: int) -> Column:
        rule = F.when(F.lit(False), "")
        for name, parts in SOURCE_TEXT.items():
            rule = rule.when(language == name, F.lit(parts[position]))
        return rule

    # One fill for head, body and tail; per function only its number is put in.
    numbers = F.sequence(F.lit(1), F.col("p_size"))
    body = let(_fill(pick(2)), lambda one: F.array_join(F.transform(numbers, lambda i: F.replace(one, F.lit("{i}"), i.cast("string"))), ""))
    damage = F.when((language == "Python") & (F.col("p_size") >= DAMAGED_FROM), DAMAGE).otherwise("")
    # The narrow rows are dealt out before the texts are made: one row group is read by one task.
    parts = table(spark, sf_dir, "part")
    parts = parts.repartition(max(1, -(-parts.count() // PARTS_PER_TASK)), "p_partkey")
    return (
        parts
        .withColumn("language", language)
        .select(
            F.concat(
                F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/part_"),
                "p_partkey", F.lit("."), pick(0),
            ).alias("filename"),
            # As an exploded column the text is made once, and conditions on it stay above the dealing out.
            F.explode_outer(F.array(F.concat(_fill(pick(1)), body, _fill(F.concat(pick(3), damage))))).alias("content"),
            F.lit("parts").alias("source_name"),
            "language", "p_partkey", "p_size",
        )
    )


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_fill(text: str, extra: str = "") -> str:
    out = text
    for mark, value in (("{id}", "p_partkey"), ("{name}", "p_name"), ("{size}", "p_size")):
        out = f"replace({out}, '{mark}', {value}::VARCHAR)"
    return out


def _source_sql() -> str:
    def pick(position: int) -> str:
        cases = " ".join(
            f"WHEN {n} THEN {_sql_text(parts[position])}" for n, parts in enumerate(SOURCE_TEXT.values())
        )
        return f"CASE p_partkey % {len(LANGUAGES)} {cases} END"

    names = " ".join(f"WHEN {n} THEN {_sql_text(name)}" for n, name in enumerate(LANGUAGES))
    one = _sql_fill("replace(body, '{i}', i::VARCHAR)")
    return f"""
  SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/part_' || p_partkey || '.' || ext AS filename,
         {_sql_fill('head')} ||
         array_to_string(list_transform(range(1, p_size + 1), lambda i: {one}), '') ||
         {_sql_fill("tail || CASE WHEN language = 'Python' AND p_size >= " + str(DAMAGED_FROM) + " THEN " + _sql_text(DAMAGE) + " ELSE '' END")} AS content,
         'parts' AS source_name, language, p_partkey, p_size
  FROM (SELECT *, CASE p_partkey % {len(LANGUAGES)} {names} END AS language, {pick(0)} AS ext,
               {pick(1)} AS head, {pick(2)} AS body, {pick(3)} AS tail FROM part)"""


SOURCES_SQL = _source_sql()
