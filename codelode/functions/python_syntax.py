"""Names and details of Python text from its syntax tree.

A small Arrow UDF lists the declarations and branches of each text as flat nodes, NULL
where the text does not parse.  Everything told about a text is then derived from its
nodes by Spark expressions.
"""

from __future__ import annotations

import ast
import gc

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions.lists import grouped, structs_of

# --- Fixed values: syntax class -> node kind ---------------------------------
NODE_KINDS = {
    "If": "if_statement", "IfExp": "conditional_expression", "For": "for_statement",
    "AsyncFor": "for_statement", "While": "while_statement", "Try": "try_statement",
    "TryStar": "try_statement", "ExceptHandler": "except_clause", "With": "with_statement",
    "AsyncWith": "with_statement", "Lambda": "lambda", "ListComp": "list_comprehension",
    "GeneratorExp": "generator_expression", "FunctionDef": "function_definition",
    "AsyncFunctionDef": "async_function_definition", "ClassDef": "class_definition",
}
_KIND_OF = {getattr(ast, n): kind for n, kind in NODE_KINDS.items()}
_DECLARED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
# Nothing is told about these or about what is below them.
_PLAIN = frozenset(
    {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal}
    | {c for base in (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop) for c in base.__subclasses__()}
)
_TEXTS = pa.list_(pa.string())
_PARAMETERS = [pa.field(n, pa.string()) for n in ("name", "type_annotation", "default")]
_FIELDS = [
    pa.field("kind", pa.string()), *[pa.field(n, pa.int32()) for n in ("place", "size", "depth")],
    pa.field("name", pa.string()), pa.field("owner", pa.string()), pa.field("line", pa.int32()), pa.field("end_line", pa.int32()),
    pa.field("returns", pa.string()), pa.field("doc", pa.string()), pa.field("decorators", _TEXTS), pa.field("bases", _TEXTS),
    pa.field("parameters", pa.list_(pa.struct(_PARAMETERS))),
]
# Nodes are held as objects for so many texts at a time.
TEXTS_AT_ONCE = 64
_SQL = (
    "array<struct<kind:string,place:int,size:int,depth:int,name:string,owner:string,line:int,end_line:int,returns:string,doc:string,"
    "decorators:array<string>,bases:array<string>,parameters:array<struct<name:string,type_annotation:string,default:string>>>>"
)


def _text(node: ast.expr | None) -> str | None:
    if node is None or isinstance(node, ast.Name):
        return node and node.id
    if isinstance(node, ast.Constant) and type(node.value) in (int, bool, type(None)):
        return repr(node.value)
    return ast.unparse(node)


def _declaration(node: ast.AST) -> dict:
    """What only a function or a class has."""
    told = {"name": node.name, "line": node.lineno, "end_line": node.end_lineno, "doc": ast.get_docstring(node)}
    told["decorators"] = [_text(getattr(d, "func", d)) for d in node.decorator_list]
    if isinstance(node, ast.ClassDef):
        return told | {"bases": [_text(b) for b in node.bases]}
    plain, given = node.args.args, node.args.defaults
    values = dict(zip(reversed(plain), reversed(given), strict=False))  # defaults belong to the last ones
    told["parameters"] = [(a.arg, _text(a.annotation), _text(values.get(a))) for a in plain]
    return told | {"returns": _text(node.returns)}


def _below(node: ast.AST) -> list[ast.AST]:
    """The children of a node in the order of the text, without plain ones."""
    found = []
    for field in node._fields:
        value = getattr(node, field, None)
        for child in value if isinstance(value, list) else (value,):
            if isinstance(child, ast.AST) and type(child) not in _PLAIN:
                found.append(child)
    return found


def _sizes(found: list[dict]) -> None:
    """Place and number of nodes below each, from the depths in the order of the text."""
    open_nodes: list[dict] = []
    for place, node in enumerate(found):
        while open_nodes and open_nodes[-1]["depth"] >= node["depth"]:
            last = open_nodes.pop()
            last["size"] = place - last["place"] - 1
        node["place"] = place
        open_nodes.append(node)
    for node in open_nodes:
        node["size"] = len(found) - node["place"] - 1


def _nodes(code: str | None) -> list[dict] | None:
    if code is None:
        return None
    try:
        tree = ast.parse(code)
        found = [{"kind": "module", "doc": ast.get_docstring(tree), "depth": 0}]
        todo: list[tuple[ast.AST, str | None, int]] = [(tree, None, 0)]
        while todo:  # in the order of the text, without recursion
            node, owner, depth = todo.pop()
            kind, before = _KIND_OF.get(type(node)), len(found)
            if isinstance(node, _DECLARED):
                found.append({"kind": kind, "owner": owner} | _declaration(node))
            elif kind:
                found.append({"kind": kind})
            elif isinstance(node, ast.Import):
                found += [{"kind": "import", "name": a.name} for a in node.names]
            elif isinstance(node, ast.ImportFrom) and node.module:
                found.append({"kind": "import", "name": node.module})
            elif isinstance(node, ast.Assign) and owner is None:
                found += [{"kind": "variable", "name": t.id} for t in node.targets if isinstance(t, ast.Name)]
            for one in found[before:]:
                one["depth"] = depth + 1
            inside = node.name if isinstance(node, ast.ClassDef) else owner
            todo += [(child, inside, depth + bool(kind)) for child in reversed(_below(node))]
        _sizes(found)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return found


def _array(rows: list[list[dict] | None]) -> pa.Array:
    """The nodes of some texts as an Arrow array, column by column."""
    flat = [n for row in rows for n in row or ()]
    columns = [[n.get(f.name) for n in flat] for f in _FIELDS]
    parameters = structs_of(columns[-1], _PARAMETERS)
    made = pa.StructArray.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns[:-1], _FIELDS)], parameters], fields=_FIELDS)
    return grouped(rows, made)


def python_nodes(code: Column) -> Column:
    """The nodes of each text, NULL where there are none to be had."""

    @F.arrow_udf(_SQL)
    def nodes(texts: pa.Array) -> pa.Array:
        # Trees and nodes hold no cycles: they go by themselves, and a search for cycles looks at all of them in vain.
        searched = gc.isenabled()
        gc.disable()
        try:
            parts = [_array([_nodes(t) for t in texts.slice(k, TEXTS_AT_ONCE).to_pylist()]) for k in range(0, len(texts), TEXTS_AT_ONCE)]
        finally:
            if searched:
                gc.enable()
        return pa.concat_arrays(parts) if parts else _array([])

    return nodes(code)


_FUNCTION = "n.kind IN ('function_definition', 'async_function_definition')"
_CLASS = "n.kind = 'class_definition'"
_PRIVATE = "startswith(n.name, '_')"
_DUNDER = "(startswith(n.name, '__') AND endswith(n.name, '__'))"


def findings_sql(nodes: str) -> dict[str, str]:
    """SQL of each thing that is told about a text, from its column of nodes; NULL without nodes.

    They are columns of their own, so Spark leaves out those that nobody asks for."""

    def those(condition: str) -> str:
        return f"filter({nodes}, n -> {condition})"

    def names(condition: str) -> str:
        return f"transform({those(condition)}, n -> n.name)"

    functions = (
        f"transform({those(f'{_FUNCTION} AND n.owner IS NULL')}, n -> named_struct('name', n.name,"
        " 'type', IF(n.kind = 'async_function_definition', 'async_function', 'function'), 'class', n.owner,"
        " 'line', n.line, 'end_line', n.end_line, 'parameters', n.parameters, 'return_type', n.returns,"
        f" 'decorators', n.decorators, 'docstring', n.doc, 'is_private', {_PRIVATE}, 'is_dunder', {_DUNDER}))"
    )
    # nodes stand in the order of the text, a class before the n.size nodes in it
    methods = f"transform(filter(slice({nodes}, n.place + 2, n.size), m -> m.kind IN ('function_definition', 'async_function_definition') AND m.owner = n.name), m -> m.name)"
    classes = (
        f"transform({those(_CLASS)}, n -> named_struct('name', n.name, 'line', n.line, 'end_line', n.end_line, 'bases', n.bases,"
        f" 'decorators', n.decorators, 'docstring', n.doc, 'is_private', {_PRIVATE}, 'methods', {methods}))"
    )
    counts = ", ".join(f"'{k}', size(filter({nodes}, n -> n.kind = '{k}'))" for k in dict.fromkeys(NODE_KINDS.values()))
    hinted = "n.returns IS NOT NULL OR exists(n.parameters, p -> p.type_annotation IS NOT NULL)"
    fields = {
        "functions": names(f"{_FUNCTION} AND n.owner IS NULL"),
        "classes": names(_CLASS),
        "imports": f"array_sort(array_distinct({names("n.kind = 'import'")}))",
        "variables": names("n.kind = 'variable'"),
        "decorators": f"array_sort(array_distinct(flatten(transform({those('n.decorators IS NOT NULL')}, n -> n.decorators))))",
        "private_methods": names(f"{_FUNCTION} AND {_PRIVATE}"),
        "dunder_methods": names(f"{_FUNCTION} AND {_DUNDER}"),
        "has_async": f"exists({nodes}, n -> n.kind = 'async_function_definition')",
        "has_type_hints": f"exists({nodes}, n -> coalesce({_FUNCTION} AND ({hinted}), false))",
        "has_docstrings": f"exists({nodes}, n -> n.kind <> 'module' AND coalesce(n.doc, '') <> '')",
        "docstring": f"coalesce({nodes}[0].doc, '')",
        "function_details": f"to_json({functions}, map('ignoreNullFields', 'false'))",
        "class_details": f"to_json({classes}, map('ignoreNullFields', 'false'))",
        "function_count": f"size({those(_FUNCTION)})",
        "decorated_count": f"size({those(f'{_FUNCTION} AND size(n.decorators) > 0')})",
        "node_counts": f"map_filter(map({counts}), (kind, n) -> n > 0)",
    }
    return {name: f"CASE WHEN {nodes} IS NOT NULL THEN {sql} END" for name, sql in fields.items()}
