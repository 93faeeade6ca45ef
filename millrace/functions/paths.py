"""Path expressions: validity, globs, ignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that storage keeps for itself.
RESERVED = (".about", ".summary", ".skills", ".knowledge", ".rebukes", ".tools", ".storageignore", "vector_meta.json")
# Directories that a walk over sources doesn't enter.
PRUNED = (
    ".git", ".svn", ".hg", "target", "node_modules", "dist", "build", "out", "vendor", ".venv", "venv", "__pycache__", ".pytest_cache",
    ".mypy_cache", ".tox", ".gradle", ".idea", ".vscode", "bin", "obj", ".cache", ".next", ".nuxt", ".parcel-cache", "coverage", ".nyc_output",
)


def segments(path: Column) -> Column:
    """Non-empty segments without the single dots."""
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def is_reserved(name: Column) -> Column:
    return F.lower(name).isin(*RESERVED)


def is_valid_id(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]+\\z")


def is_safe(path: Column, absolute: bool = True) -> Column:
    """No parent segments, no reserved names; a leading slash is ignored, or refused with ``absolute=False``."""
    fine = ~F.exists(segments(path), lambda s: (s == "..") | is_reserved(s))
    return fine if absolute else fine & ~path.startswith("/")


def glob_regex(glob: str) -> str:
    """Anchored expression of a glob of * and ?; neither crosses a slash."""
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
    return f"^{body}\\z"


def parse_ignore(text: str) -> list[tuple[str, str]]:
    """(kind, glob) of the lines: path with a leading slash, else name; blank lines and comments say nothing."""
    found = []
    for line in (x.strip() for x in text.splitlines()):
        if line and not line.startswith("#"):
            found.append(("path", line[1:]) if line.startswith("/") else ("name", line))
    return found


def parse_gitignore(text: str) -> list[str]:
    """Distinct patterns without the slashes around them; blank lines, comments and negations say nothing."""
    lines = (x.strip() for x in text.splitlines())
    found = (x.strip("/") for x in lines if x and x[0] not in "#!")
    return list(dict.fromkeys(x for x in found if x))


def is_pruned(path: Column) -> Column:
    """Whether a directory of the path is one that a walk doesn't enter; the last segment is a file's name."""
    parts = segments(path)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, PRUNED)))


def is_ignored(path: Column, patterns: list[tuple[str, str]]) -> Column:
    """A name matches any segment; a path pattern matches the path or one of its prefixes with as many segments."""
    parts = segments(path)
    out = F.lit(False)
    for kind, glob in patterns:
        if kind == "name":
            out = out | _any_matches(parts, glob_regex(glob))
        else:
            out = out | F.array_join(F.slice(parts, 1, len(glob.split("/"))), "/").rlike(glob_regex(glob))
    return out


def _any_matches(parts: Column, regex: str) -> Column:
    return F.exists(parts, lambda s: s.rlike(regex))


def is_valid_glob(glob: Column) -> Column:
    return glob.rlike("^[A-Za-z0-9*?._/-]+\\z") & ~glob.contains("..") & ~glob.startswith("/")


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def prefixes(path: Column) -> Column:
    """Every directory of a path and the path itself."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def snapshot_diff(disk: DataFrame, index: DataFrame, *by: str) -> DataFrame:
    """(path, action): keep, replace (any of ``by`` differs), add or remove."""
    d, i = disk.select("path", F.struct(*by).alias("d")), index.select("path", F.struct(*by).alias("i"))
    action = F.when(F.col("i").isNull(), "add").when(F.col("d").isNull(), "remove").when(F.col("d") != F.col("i"), "replace").otherwise("keep")
    return d.join(i, "path", "full").select("path", action.alias("action"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows in place of those with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)
