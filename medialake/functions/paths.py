"""Paths with `/` between their parts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def dirname(path: Column) -> Column:
    """`/` for a file at the top, `.` for a bare name."""
    return F.when(path.rlike("^/[^/]*$"), "/").when(~path.contains("/"), ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def stem(path: Column) -> Column:
    """The base name without its extension; a name that only starts with a dot has none."""
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def extension_of(path: Column) -> Column:
    """Bare and lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def ancestors(path: Column, itself: bool = False) -> Column:
    """Every directory above a path (and the path), without `/` itself: what a containing root can be equal to."""
    parts = F.split(path, "/")
    last = F.size(parts) if itself else F.size(parts) - 1
    return F.when(last >= 2, F.transform(F.sequence(F.lit(2), last), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def is_within(root: Column, path: Column) -> Column:
    """`/music` holds `/music/a`, but neither `/musical/b` nor itself."""
    return F.startswith(path, F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def hidden_below(root: Column, path: Column) -> Column:
    """Whether some part below the root starts with a dot."""
    return F.substring(path, F.length(root) + 1, F.length(path)).rlike(r"(^|/)\.")


def is_plain_absolute(path: Column) -> Column:
    """Absolute, and with no empty, `.` or `..` part and no slash at its end."""
    return path.rlike("^/") & ~path.rlike(r"//|/\.{1,2}(/|$)") & ((path == "/") | ~path.endswith("/"))


def rebase(path: Column, old: Column, new: Column) -> Column:
    """The path with its leading old directory replaced; others stay."""
    return F.when((path == old) | is_within(old, path), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)
