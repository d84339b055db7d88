"""What is left out of a reconciliation: reserved paths, junk, hidden paths out of scope, and ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import paths


def _to_regex(pattern: str) -> str:
    """One pattern of the ignore language as a regular expression over whole paths."""
    anchored = "/" in pattern.rstrip("/")
    body, folder_only = pattern.strip("/") if pattern.startswith("/") else pattern.rstrip("/"), pattern.endswith("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.+")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            inside = body[i + 1 : end]
            out.append(f"[{'^' + inside[1:] if inside[0] in '!^' else inside}]")
            i = end + 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{''.join(out)}{'/' if folder_only else ''}"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """The last pattern that matches decides, at every level from the top: below an excluded folder nothing comes back.

    Only built-in expressions: each ancestor, with a slash behind it, and the path itself are judged, and one verdict is enough.
    """
    rules = [(p[1:] if p.startswith("!") else p, p.startswith("!")) for p in (x.rstrip() for x in patterns) if p and not p.startswith("#")]
    if not rules:
        return F.lit(False)

    def judged(candidate: Column) -> Column:
        verdict = F.lit(False)
        for pattern, negated in rules:
            # a folder pattern needs the slash behind the name, any other may end with or without one
            expression = _to_regex(pattern) + ("$" if pattern.endswith("/") else "/?$")
            verdict = F.when(F.rlike(candidate, F.lit(expression)), F.lit(not negated)).otherwise(verdict)
        return verdict

    above = F.transform(paths.ancestors(path), lambda a: F.concat(a, F.lit("/")))
    return F.exists(F.array_append(above, path), judged)


def excluded(path: Column, *, reserved: Sequence[str] = (), roots: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    held = F.lit(False)
    for r in reserved:
        held = held | (path == r) | F.startswith(path, F.lit(f"{r}/"))
    return held | paths.is_junk(path) | paths.hidden_out_of_scope(path, roots) | ignored(path, patterns)
