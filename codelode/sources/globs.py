"""Glob and .gitignore patterns as one regular expression for ``rlike``.

Patterns are configuration, so they are turned into text on the driver once;
matching itself is a Spark ``rlike`` over the path column.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_GLOB_TOKEN = re.compile(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]+\]|.", re.S)
_REGEX_OF = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def gitignore_to_globs(pattern: str) -> list[str]:
    """One .gitignore line as zero, one or two globs.

    Blank lines, comments and negations give nothing.  ``/x`` stays at the root,
    anything else matches at every depth, ``x/`` also covers what is inside.
    """
    text = pattern.strip()
    if not text or text[0] in "#!":
        return []
    folder = text.endswith("/")
    text = text.removesuffix("/")
    if text.startswith("/"):
        text = text[1:]
    elif text and not text.startswith("**/"):
        text = f"**/{text}"
    if not text:
        return []
    return [text, f"{text}/**"] if folder else [text]


def gitignore_globs(lines: Iterable[str], folder: str = "") -> list[str]:
    """All globs of one .gitignore; ``folder`` is its place below the root."""
    prefix = f"{folder.strip('/')}/" if folder.strip("./") else ""
    return [prefix + g for line in lines for g in gitignore_to_globs(line)]


def glob_to_regex(glob: str) -> str:
    """Anchored regex for one path glob; a glob also covers the folder's content.

    A glob without a slash matches at any depth, as in .gitignore files.
    """
    text = glob.strip()
    if "/" not in text.rstrip("/"):
        text = f"**/{text}"
    text = text.lstrip("/").rstrip("/")
    parts = []
    for token in _GLOB_TOKEN.findall(text):
        if token in _REGEX_OF:
            parts.append(_REGEX_OF[token])
        elif token[0] == "[" and len(token) > 1:
            parts.append("[^" + token[2:] if token[1] == "!" else token)
        else:
            parts.append(re.escape(token))
    return "^" + "".join(parts) + "(?:/.*)?$"


def globs_to_regex(globs: Iterable[str]) -> str | None:
    """One alternation for many globs; ``None`` for an empty list."""
    bodies = [f"(?:{glob_to_regex(g)[1:-1]})" for g in dict.fromkeys(globs)]
    return f"^(?:{'|'.join(bodies)})$" if bodies else None


def path_matches(path: Column, includes: Iterable[str], excludes: Iterable[str]) -> Column:
    """True where a relative path is included and not excluded.

    An empty include list lets nothing through.
    """
    include, exclude = globs_to_regex(includes), globs_to_regex(excludes)
    if include is None:
        return F.lit(False)
    keep = path.rlike(include)
    return keep & ~path.rlike(exclude) if exclude else keep


def choose_patterns(
    default_includes: list[str],
    default_excludes: list[str],
    gitignore: list[str],
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    use_gitignore: bool = True,
) -> tuple[list[str], list[str]]:
    """Which patterns a run uses.

    A user's includes replace the defaults; .gitignore globs replace the default
    excludes; a user's excludes are added on top (read as .gitignore lines).
    """
    includes = list(include) if include else list(default_includes)
    excludes = list(gitignore) if use_gitignore and gitignore else list(default_excludes)
    return includes, excludes + gitignore_globs(exclude or [])


def listing_glob(includes: Iterable[str]) -> str | None:
    """A file-name filter for the scan itself, if every include is ``**/name``.

    Spark applies it while listing, so other files are never opened.
    """
    names = []
    for glob in includes:
        name = glob.removeprefix("**/")
        if not glob.startswith("**/") or re.search(r"[/{},\\]", name) or "**" in name:
            return None
        names.append(name)
    return "{" + ",".join(names) + "}" if names else None
