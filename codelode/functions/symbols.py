"""Names declared in source text, per language, by regular expression.

No syntax-tree library is available inside Spark, so declarations are found by
line shape.  The patterns are data; the work is Spark's ``regexp_extract_all``,
which stays in the JVM.  Repeated groups are possessive (``*+``): Java matches those in
a loop, others by recursion that overflows on long text.  Blanks at the start of a line are
possessive too: nothing after them begins with a blank, so giving them back finds nothing.  A pattern captures the declared name in group 1; a
whole match that fits ``NOT_A_DECLARATION`` is dropped.
"""

from __future__ import annotations

from codelode.functions import text
from codelode.functions.sqltext import EMPTY_LIST, case, literal, one_of

_N = r"([A-Za-z_$][\w$]*)"
_JAVA_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|default|native|strictfp)\s+)*+"
_KT_MODS = (
    r"(?:(?:public|private|protected|internal|open|abstract|final|override|suspend|inline|"
    r"operator|infix|tailrec|sealed|inner|external|actual|expect|const|lateinit)\s+)*+"
)
_RS_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_JS_EXPORT = r"(?:export\s+)?(?:default\s+)?"

_C = {
    "functions": [r"(?m)^[A-Za-z_][\w \t*]*[ \t*]+\*?([A-Za-z_]\w*)\s*\([^;{}]*\)\s*\{"],
    "structs": [r"\bstruct\s+([A-Za-z_]\w*)\s*\{"],
    "enums": [r"\benum\s+(?:class\s+|struct\s+)?([A-Za-z_]\w*)\s*(?::\s*\w+\s*)?\{"],
    "typedefs": [r"(?m)^\s*+typedef\s+[^;{}]*?\b([A-Za-z_]\w*)\s*;", r"(?m)^\}\s*([A-Za-z_]\w*)\s*;"],
}
_CPP = {
    **_C,
    "functions": [
        r"(?m)^[ \t]*+[A-Za-z_][\w:<>,&* \t]*[ \t*&]+\*?(?:\w+::)*+(~?[A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?\{",
    ],
    "classes": [
        r"(?m)^[ \t]*+(?:template\s*<[^\n]*>\s*)?class\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^;{]*)?\{"
    ],
    "namespaces": [r"\bnamespace\s+([A-Za-z_]\w*)"],
    "templates": [r"\btemplate\s*<[^;{]*?>\s*(?:class|struct)\s+([A-Za-z_]\w*)"],
}
_JS = {
    "functions": [
        r"\bfunction\s*\*?\s+" + _N + r"\s*\(",
        r"(?m)^\s*+" + _JS_EXPORT + r"(?:const|let|var)\s+" + _N
        + r"\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::\s*[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)",
        r"(?m)^[ \t]++(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*+\*?" + _N
        + r"\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::\s*[^{};=\n]+)?\{",
    ],
    "classes": [r"(?m)^\s*+" + _JS_EXPORT + r"(?:abstract\s+)?class\s+" + _N],
    "imports": [r"""(?m)^\s*+import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]"""],
    "exports": [
        r"(?m)^\s*+export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum|namespace)\s+" + _N
    ],
}
_TS = {
    **_JS,
    "interfaces": [r"(?m)^\s*+(?:export\s+)?(?:default\s+)?interface\s+" + _N],
    "types": [r"(?m)^\s*+(?:export\s+)?type\s+" + _N + r"\s*(?:<[^=\n]*>)?\s*="],
    "enums": [r"(?m)^\s*+(?:export\s+)?(?:const\s+)?enum\s+" + _N],
    "namespaces": [r"(?m)^\s*+(?:export\s+)?(?:declare\s+)?(?:namespace|module)\s+([\w$.]+)\s*\{"],
    "decorators": [r"(?m)^\s*+@" + _N],
}
PATTERNS: dict[str, dict[str, list[str]]] = {
    "C": _C,
    "C++": _CPP,
    "Java": {
        "functions": [
            r"(?m)^\s*+(?:@\w+(?:\([^)\n]*\))?\s+)*+" + _JAVA_MODS
            + r"(?:<[^>\n]+>\s+)?[\w$][\w$.<>\[\],? ]*\s+" + _N + r"\s*\([^;{}()]*\)\s*(?:throws\s+[\w., \t\n]+)?[{;]",
            r"(?m)^\s*+(?:public|protected|private)\s+" + _N + r"\s*\([^;{}()]*\)\s*(?:throws\s+[\w., \t\n]+)?\{",
        ],
        "classes": [r"(?m)^\s*+" + _JAVA_MODS + r"(?:sealed\s+|non-sealed\s+)?class\s+" + _N],
        "interfaces": [r"(?m)^\s*+" + _JAVA_MODS + r"interface\s+" + _N],
        "enums": [r"(?m)^\s*+" + _JAVA_MODS + r"enum\s+" + _N],
        "packages": [r"(?m)^\s*+package\s+([\w.]+)\s*;"],
        "annotations": [r"@interface\s+" + _N],
    },
    "JavaScript": _JS,
    "TypeScript": _TS,
    "TSX": _TS,
    "Kotlin": {
        "functions": [r"(?m)^\s*+" + _KT_MODS + r"fun\s+(?:<[^>\n]+>\s+)?(?:[\w.<>?]+\.)?" + _N + r"\s*\("],
        "classes": [
            r"(?m)^\s*+" + _KT_MODS + r"(?:data\s+|annotation\s+|value\s+)?class\s+" + _N
        ],
        "data_classes": [r"(?m)^\s*+" + _KT_MODS + r"data\s+class\s+" + _N],
        "interfaces": [r"(?m)^\s*+" + _KT_MODS + r"(?:fun\s+)?interface\s+" + _N],
        "objects": [r"(?m)^\s*+" + _KT_MODS + r"(?:companion\s+|data\s+)?object\s+" + _N],
        "enums": [r"(?m)^\s*+" + _KT_MODS + r"enum\s+class\s+" + _N],
    },
    "Rust": {
        "functions": [
            r"(?m)^\s*+" + _RS_PUB + r"(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*+fn\s+" + _N + r"\s*[<(]"
        ],
        "structs": [r"(?m)^\s*+" + _RS_PUB + r"struct\s+" + _N],
        "enums": [r"(?m)^\s*+" + _RS_PUB + r"enum\s+" + _N],
        "traits": [r"(?m)^\s*+" + _RS_PUB + r"(?:unsafe\s+)?trait\s+" + _N],
        "impls": [r"(?m)^\s*+(?:unsafe\s+)?impl(?:<[^>\n]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)"],
        "modules": [r"(?m)^\s*+" + _RS_PUB + r"mod\s+" + _N],
    },
    "Haskell": {
        "functions": [
            r"(?m)^([a-z_][\w']*)\s*(?:,\s*[a-z_][\w']*\s*)*+::",
            r"(?m)^([a-z_][\w']*)(?:[ \t]+[^\n=:|]+)?[ \t]*(?:=[^=>]|\|)",
        ],
        "data_types": [r"(?m)^(?:data|newtype)\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*)"],
        "types": [r"(?m)^type\s+([A-Z][\w']*)"],
        "type_classes": [r"(?m)^class\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*)"],
        "classes": [r"(?m)^class\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*)"],
        "instances": [r"(?m)^instance\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*\s+\(?[A-Z\[][\w']*)"],
        "modules": [r"(?m)^module\s+([A-Z][\w.']*)"],
        "imports": [r"(?m)^import\s+(?:qualified\s+)?([A-Z][\w.]*)"],
    },
}
NOT_A_DECLARATION = (
    r"^\s*(?:\}\s*)?(?:return|else|new|throw|case|await|yield|if|for|while|switch|catch|do|delete|"
    r"using|goto|super|this|where|let|in|module|import|data|newtype|type|class|instance|deriving|infix[lr]?)\b"
)
NOT_A_NAME = [
    "if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "function", "super",
    "constructor", "where", "let", "in", "of", "then", "case", "synchronized", "try",
]
# Words of which every match of a field's patterns holds one: a text without them is not searched.
NEEDED = {
    "classes": ["class"], "structs": ["struct"], "enums": ["enum"], "templates": ["template"], "interfaces": ["interface"],
    "packages": ["package"], "annotations": ["@interface"], "data_classes": ["data"], "objects": ["object"],
    "traits": ["trait"], "impls": ["impl"], "exports": ["export"], "imports": ["import"], "types": ["type"],
    "type_classes": ["class"], "instances": ["instance"], "decorators": ["@"], "modules": ["mod"],
    "namespaces": ["namespace", "module"], "data_types": ["data", "newtype"],
}
# Comment shapes; text literals are matched first so that a comment mark inside
# one does not count.
_STRING = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*+"'
_SLASH = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"
COMMENTS = {
    **dict.fromkeys(["C", "C++", "Java", "JavaScript", "TypeScript", "TSX", "Kotlin", "Rust"], _SLASH),
    "Haskell": r"--[^\n]*|\{-(?:[^-]|-(?!\}))*+-\}",
}
# What a literal or a comment begins with: one look at a character passes over the rest of the text.
_BEGINS = {_SLASH: r'(?=["/])', COMMENTS["Haskell"]: r'(?=["{-])'}


def _grouped(values: dict) -> dict:
    """Equal values with all the languages that share them."""
    groups: dict = {}
    for language, value in values.items():
        groups.setdefault(value, []).append(language)
    return groups


def without_comments(code: str, language: str) -> str:
    """SQL for the text with comments removed, string literals kept."""
    branches = [
        (one_of(language, members), f"regexp_replace({code}, {literal(f'{_BEGINS[shape]}(?:({_STRING})|{shape})')}, '$1')")
        for shape, members in _grouped(COMMENTS).items()
    ]
    return case(branches, code)


def without_literals(code: str, language: str) -> str:
    """SQL for the text without comments and string literals: brackets and words left are code."""
    branches = [
        (one_of(language, members), f"regexp_replace({code}, {literal(f'{_BEGINS[shape]}(?:{_STRING}|{shape})')}, ' ')")
        for shape, members in _grouped(COMMENTS).items()
    ]
    return case(branches, code)


def declared(code: str, patterns: tuple[str, ...], guard: bool) -> str:
    """SQL for the distinct names, in order of appearance per pattern."""
    parts = []
    for pattern in patterns:
        if guard:
            parts.append(
                f"transform(filter({text.find_all_sql(code, pattern, 0)}, m -> NOT m RLIKE {literal(NOT_A_DECLARATION)}),"
                f" m -> regexp_extract(m, {literal(pattern)}, 1))"
            )
        else:
            parts.append(text.find_all_sql(code, pattern))
    found = parts[0] if len(parts) == 1 else f"flatten(array({', '.join(parts)}))"
    return f"array_distinct(filter({found}, n -> n != '' AND NOT {one_of('n', NOT_A_NAME)}))"


def declared_names(code: str, language: str) -> dict[str, str]:
    """SQL per field for an array of names; ``[]`` where a language has none."""
    fields = dict.fromkeys(f for table in PATTERNS.values() for f in table)
    out = {}
    for field in fields:
        groups = _grouped({n: tuple(t[field]) for n, t in PATTERNS.items() if field in t})
        branches = [
            (one_of(language, members), declared(code, patterns, field == "functions"))
            for patterns, members in groups.items()
        ]
        if field in NEEDED:
            lacking = " AND ".join(f"NOT contains({code}, {literal(w)})" for w in NEEDED[field])
            branches.insert(0, (lacking, EMPTY_LIST))
        out[field] = case(branches, EMPTY_LIST)
    return out


# Keywords and arrows of the weighted node kinds, for the complexity score; one kind is told by a shape.
_RUST_FOR = r"\bfor\b[^{;]*\bin\b"
_CURLY_NODES = {
    "if_statement": "if", "for_statement": "for", "while_statement": "while", "switch_statement": "switch", "case_statement": "case",
}
_TRY_NODES = {"try_statement": "try", "catch_clause": "catch", "finally_clause": "finally"}
NODE_WORDS: dict[str, dict[str, str]] = {
    "C": _CURLY_NODES,
    "C++": {**_CURLY_NODES, **_TRY_NODES},
    "Java": {**_CURLY_NODES, **_TRY_NODES, "lambda_expression": "->"},
    "JavaScript": {**_CURLY_NODES, **_TRY_NODES, "arrow_function": "=>"},
    "TypeScript": {**_CURLY_NODES, **_TRY_NODES, "arrow_function": "=>"},
    "TSX": {**_CURLY_NODES, **_TRY_NODES, "arrow_function": "=>"},
    "Kotlin": {"if_expression": "if", "for_statement": "for", "while_statement": "while", **_TRY_NODES},
    "Rust": {
        "if_expression": "if", "for_expression": _RUST_FOR, "while_statement": "while", "loop_expression": "loop",
        "match_expression": "match", "match_arm": "=>",
    },
}
DECLARED_NODES: dict[str, dict[str, str]] = {
    "C": {"functions": "function_definition"},
    "C++": {"functions": "function_definition"},
    "Java": {
        "functions": "method_declaration", "classes": "class_declaration",
        "interfaces": "interface_declaration",
    },
    "JavaScript": {"functions": "function_declaration", "classes": "class_declaration"},
    "TypeScript": {
        "functions": "function_declaration", "classes": "class_declaration",
        "interfaces": "interface_declaration",
    },
    "TSX": {
        "functions": "function_declaration", "classes": "class_declaration",
        "interfaces": "interface_declaration",
    },
    "Kotlin": {"functions": "function_declaration", "classes": "class_declaration"},
    "Rust": {
        "functions": "function_item", "structs": "struct_item", "enums": "enum_item",
        "traits": "trait_item", "impls": "impl_item",
    },
}


def _words(words: list[str]) -> str:
    """One pattern for whole words and arrows; the first character is looked at before anything else."""
    plain = "|".join(w for w in words if w.isalpha())
    arrows = [w for w in words if not w.isalpha()]
    first = "".join(dict.fromkeys(w[0] for w in words if w.isalpha())) + "".join(rf"\{w[0]}" for w in arrows)
    return rf"(?=[{first}])(?:{'|'.join([rf'{chr(92)}b(?:{plain}){chr(92)}b', *arrows])})"


def node_counts(code: str, language: str, lists: dict[str, str]) -> str:
    """SQL for a histogram of node kinds as a map, without zero entries.

    ``lists`` names the columns that hold the declared names.  The words of all kinds
    are found in one search.
    """
    branches = []
    for name, words in NODE_WORDS.items():
        pairs = [
            (kind, text.matches_sql(code, word) if word == _RUST_FOR else f"size(filter(w, x -> x = {literal(word)}))")
            for kind, word in words.items()
        ]
        pairs += [(kind, f"size({lists[field]})") for field, kind in DECLARED_NODES[name].items()]
        entries = ", ".join(f"struct({literal(k)} AS k, cast({v} AS bigint) AS v)" for k, v in pairs)
        found = text.find_all_sql(code, _words([w for w in words.values() if w != _RUST_FOR]), 0)
        branches.append((
            f"{language} = {literal(name)}",
            f"map_from_entries(transform(array({found}), w -> filter(array({entries}), e -> e.v > 0))[0])",
        ))
    return case(branches, "cast(map() AS map<string,bigint>)")


def bracket_errors(code: str) -> str:
    """SQL for unmatched brackets: the difference of opening and closing ones, counted in what is left of the text without the rest."""
    parts = [f"abs(({text.count_sql('b', [x])}) - ({text.count_sql('b', [y])}))" for x, y in ("()", "[]", "{}")]
    brackets = f"regexp_replace({code}, {literal(r'[^()\[\]{}]++')}, '')"
    return f"transform(array({brackets}), b -> cast({' + '.join(parts)} AS bigint))[0]"
