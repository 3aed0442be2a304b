"""Admission rules: which notes are searchable and where crawled output may go."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip


def indexable_path(rel: Column) -> Column:
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    skipped = F.array(*[F.lit(n) for n in fixed.SKIPPED_FOLDERS])
    name = F.lower(F.get(parts, F.size(parts) - 1))
    return F.coalesce((name != "readme.md") & ~F.arrays_overlap(parts, skipped), F.lit(False))


def indexable_meta(course: Column, source_type: Column, status: Column) -> Column:
    """Blank course fails; absent or unknown type and status values count as human and approved."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", strip(c))
    kind, state = filled(source_type), filled(status)
    type_ok = kind.isNull() | ~kind.isin(*fixed.SOURCE_TYPES) | kind.isin(*fixed.SEARCHABLE_TYPES)
    state_ok = state.isNull() | ~state.isin(*fixed.INGEST_STATUSES) | (state == "approved")
    return (strip(F.coalesce(course, F.lit(""))) != "") & type_ok & state_ok


def min_chars(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(F.length(column) >= n)


def resolved(path: Column) -> Column:
    """Absolute path without empty, `.` and `..` parts; a path without a leading slash starts at the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def output_allowed(path: Column, knowledge_root: str, allow_knowledge_write: bool = False) -> Column:
    """False for targets below the knowledge root, except its `_inbox`; paths are resolved first."""
    root, path = posixpath.normpath(knowledge_root), resolved(path)
    below = (path == root) | path.startswith(root + "/")
    inbox = (path == root + "/_inbox") | path.startswith(root + "/_inbox/")
    return F.lit(allow_knowledge_write) | ~below | inbox


def assert_output_allowed(path: str, knowledge_root: str, allow_knowledge_write: bool = False) -> None:
    root, target = posixpath.normpath(knowledge_root), posixpath.normpath(path)
    inside = target == root or target.startswith(root + "/")
    inbox = target == root + "/_inbox" or target.startswith(root + "/_inbox/")
    if inside and not inbox and not allow_knowledge_write:
        raise ValueError(f"SOURCE_INGEST_DENIED: crawled output may not be written to {path}")


def known_courses(requested: str | None, known: tuple[str, ...] = fixed.KNOWN_COURSES) -> list[str]:
    """Comma-separated course names to a list; blank or `all` selects every known course."""
    if requested is None or requested.strip().lower() in ("", "all"):
        return list(known)
    names = list(dict.fromkeys(p.strip().lower() for p in requested.split(",") if p.strip()))
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown course: {unknown[0]}")
    if not names:
        raise ValueError("courses must not be empty")
    return names
