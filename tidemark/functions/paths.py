"""Paths are relative, "/"-separated, without slashes at the ends. Prefix tests are literal, never LIKE: "_" and "%" are legal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base names that operating systems leave behind.
JUNK = ("desktop.ini", "thumbs.db", ".ds_store")


def normalize(path: Column) -> Column:
    slashes = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, "^/|/$", "")


def extension(path: Column) -> Column:
    """Lower case, with its dot; "" without one. A base name's leading dot counts."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    return F.size(segments(path))


def under(path: Column, folder: Column) -> Column:
    return F.startswith(path, F.concat(folder, F.lit("/")))


def ancestors(path: Column) -> Column:
    """Proper ancestors, the shallowest first; the root isn't one."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def rebase(path: Column, old: Column, new: Column) -> Column:
    """Put ``new`` for the prefix ``old``."""
    return F.concat(new, F.substring(path, F.char_length(old) + 1, F.char_length(path)))


def relativize(lower_path: Column, display_path: Column, root: str) -> Column:
    """The display path below a root that is matched without case; null outside of it."""
    wanted = [s for s in root.lower().split("/") if s]
    low, shown, n = segments(lower_path), segments(display_path), len(wanted)
    inside = F.slice(low, 1, n) == F.array(*map(F.lit, wanted)) if n else F.lit(True)
    return F.when(inside & (F.size(low) >= n), F.array_join(F.slice(shown, n + 1, F.greatest(F.size(shown) - n, F.lit(0))), "/"))


def rename_is_valid(old: Column, new: Column) -> Column:
    return (old != new) & ~under(new, old)


def conflict_name(path: Column, n: Column) -> Column:
    """``.conflict`` before the extension, numbered from the second."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    mark = F.when(n == 1, F.lit(".conflict")).otherwise(F.concat(F.lit(".conflict-"), n.cast("string")))
    return F.concat(F.substring(path, F.lit(1), F.char_length(path) - F.char_length(ext)), mark, ext)


def is_junk(path: Column) -> Column:
    return F.lower(basename(path)).isin(*JUNK)


def is_hidden(path: Column) -> Column:
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))


def hidden_out_of_scope(path: Column, roots: Sequence[str]) -> Column:
    inside = F.lit(False)
    for root in (r.rstrip("/") for r in roots):
        inside = inside | (path == root) | F.startswith(path, F.lit(f"{root}/"))
    return is_hidden(path) & ~inside


def slug(name: Column) -> Column:
    """A name that is safe as a file name."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def parse_lines(text: Column, prefix: str = "") -> Column:
    """Lines, trimmed and without slashes at the ends, that are not empty and have the prefix; the first of equal ones."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, "\r", "")), "^/+|/+$", ""))
    return F.array_distinct(F.filter(lines, lambda s: (s != "") & F.startswith(s, F.lit(prefix))))
