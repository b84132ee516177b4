"""Lists of records joined by name or by place: findings of two analyzers, signatures of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.sqltext import literal
from codelode.operators.layout import FORMS, NAME

# A declaration: a line at the margin and the indented lines below it.
BLOCK = r"(?m)^[^\s][^\n]*(?:\n[ \t]+[^\n]*)*"
_PATTERN = {n: p for n, _, p in FORMS}
_OTHER = "|".join(f"(?:{p[1:]})" for n, _, p in FORMS if n not in (2, 3))
NOT_A_FUNCTION = f"^(?:{_OTHER})"
SIGNED_NAMES, TYPE = r"^([^:]*?)\s*::", r"(?s)^[^:]*?\s*::\s*(.*)$"
ANY_NAME = r"[a-z_][A-Za-z0-9_']*|\([^A-Za-z0-9() ]+\)"


def merge_by_name(left: str, right: str, fields: dict[str, str], prefer_right: tuple[str, ...] = ("decorators",)) -> str:
    """SQL for two arrays of structs as one, by ``name``: the left ones in their order, then
    those only on the right; of records with one name on one side the first counts.

    ``fields`` maps each other field to its SQL type.  A field comes from the left record,
    or from the right one where it is NULL or empty on the left; those in ``prefer_right``
    the other way round.  NULL counts as no records, records without a name are left out.
    """

    def first(records: str) -> str:
        named = f"filter(coalesce({records}, array()), r -> r.name IS NOT NULL)"
        return f"transform(array({named}), rs -> filter(rs, (r, i) -> array_position(transform(rs, o -> o.name), r.name) = i + 1))[0]"

    def empty(value: str, kind: str) -> str:
        if kind.startswith("array"):
            return f"coalesce(size({value}), 0) <= 0"
        return f"coalesce({value}, '') = ''" if kind == "string" else f"{value} IS NULL"

    def pick(field: str, kind: str) -> str:
        one, two = ("y", "x") if field in prefer_right else ("x", "y")
        one, two = f"{one}.{field}", f"{two}.{field}"
        return f"'{field}', CASE WHEN NOT ({empty(one, kind)}) THEN {one} WHEN NOT ({empty(two, kind)}) THEN {two} ELSE coalesce({one}, {two}) END"

    entries = "map_from_entries(transform({0}, r -> struct(r.name, r)))"
    made = ", ".join(["'name', k", *(pick(f, kind) for f, kind in fields.items())])
    # both lists are bound once; a lambda would compute them again for every record
    joined = f"map_zip_with({entries.format('b.l')}, {entries.format('b.r')}, (k, x, y) -> named_struct({made}))"
    order = "array_distinct(concat(transform(b.l, r -> r.name), transform(b.r, r -> r.name)))"
    ordered = f"transform(array(struct({joined} AS m, {order} AS o)), z -> transform(z.o, k -> element_at(z.m, k)))[0]"
    return f"transform(array(struct({first(left)} AS l, {first(right)} AS r)), b -> {ordered})[0]"


def arity(signature: Column) -> Column:
    """Arguments of a type: its arrows outside brackets (of up to four levels)."""
    bare = signature
    for _ in range(4):
        bare = F.regexp_replace(bare, r"\([^()]*\)|\[[^\[\]]*\]", "")
    return F.regexp_count(F.regexp_replace(bare, r"^(?s).*=>", ""), F.lit("->")).cast("bigint")


def signed_functions(df: DataFrame, key: str = "filename", content: str = "content") -> DataFrame:
    """One row per function of each Haskell text: key, name, ordinal, clauses, signature, arity.

    ``ordinal`` counts the declarations of the text from 0.  A function's signature is the
    nearest one before its first clause that lists its name, NULL without one; a signature
    without a function has no row.  NULL and empty texts have no functions; ``key`` is taken
    to be unique.
    """
    blocks = df.select(key, F.posexplode_outer(F.regexp_extract_all(F.col(content), F.lit(BLOCK), F.lit(0))).alias("ordinal", "_block"))
    signed = F.col("_block").rlike(_PATTERN[2]) & ~F.col("_block").rlike(NOT_A_FUNCTION)
    defined = F.col("_block").rlike(_PATTERN[3]) & ~F.col("_block").rlike(NOT_A_FUNCTION) & ~signed
    names = F.when(signed, F.expr(f"regexp_extract_all(regexp_extract(_block, {literal(SIGNED_NAMES)}, 1), {literal(ANY_NAME)}, 0)")).when(
        defined, F.array(F.regexp_extract("_block", NAME, 1))
    )
    kind = F.regexp_replace(F.trim(F.regexp_extract("_block", TYPE, 1)), r"\s+", " ")
    rows = blocks.filter(signed | defined).select(key, "ordinal", defined.alias("_defined"), F.when(signed, kind).alias("_type"), F.explode_outer(names).alias("name"))
    before = Window.partitionBy(key, "name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("signature", F.last("_type", ignorenulls=True).over(before)).filter("_defined")
    found = told.groupBy(key, "name").agg(F.min("ordinal").cast("bigint").alias("ordinal"), F.count("*").alias("clauses"), F.min_by("signature", "ordinal").alias("signature"))
    return found.withColumn("arity", arity(F.col("signature")))


# --- Fixed values: fields of the details of functions and classes --------------------
_COMMON = {"line": "int", "end_line": "int", "docstring": "string", "is_private": "boolean", "decorators": "array<string>"}
CLASS_FIELDS = _COMMON | {"bases": "array<string>", "methods": "array<string>"}
FUNCTION_FIELDS = _COMMON | {
    "type": "string", "class": "string", "return_type": "string", "is_dunder": "boolean",
    "parameters": "array<struct<name:string,type_annotation:string,default:string>>",
}


def merged_details(df: DataFrame, left: str, right: str, out: str, fields: dict[str, str] = CLASS_FIELDS) -> DataFrame:
    """Two columns of JSON details (such as ``class_details`` of two analyzers) as one, by name.

    A text that is no list of records has none."""
    kind = "array<struct<`name`:string," + ",".join(f"`{f}`:{k}" for f, k in fields.items()) + ">>"
    both = df.withColumns({"_l": F.from_json(left, kind), "_r": F.from_json(right, kind)})
    merged = F.to_json(F.expr(merge_by_name("_l", "_r", fields)), {"ignoreNullFields": "false"})
    return both.withColumn(out, merged).drop("_l", "_r")
