"""Paths and messages as column expressions."""

from __future__ import annotations

import urllib.parse
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HARDLINK, SYMLINK


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """Names of the directories on the way to a file, without the empty name before the first slash."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p != "")


def escape_path(path: Column) -> Column:
    return F.replace(F.replace(F.replace(path, F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def priority(path: Column, prefixes: Sequence[str]) -> Column:
    """Index of the first prefix that the path begins with, as plain text; null if none."""
    return F.coalesce(F.lit(None).cast("int"), *(F.when(F.startswith(path, F.lit(p)), F.lit(k)) for k, p in enumerate(prefixes)))


def relative_path(source: Column, target: Column) -> Column:
    """The path to source from the directory of target; both absolute and clean."""
    here, there = directories(target), F.filter(F.split(source, "/"), lambda p: p != "")
    n = F.least(F.size(here), F.size(there) - 1)
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.slice(here, 1, k) == F.slice(there, 1, k))
    shared = F.array_max(same)
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(here) - shared), F.slice(there, shared + 1, F.size(there))), "/")


#: Characters of a quoted text that one folder's name takes; file systems allow 255 bytes.
PIECE = 200


def as_folders(text: str) -> str:
    """A relative path of folders that stands for any text: quoted, in pieces, each with an underscore behind it, so that no name is empty, a dot or ends in .bak."""
    quoted = urllib.parse.quote(text, safe="")
    return "/".join(quoted[a : a + PIECE] + "_" for a in range(0, max(len(quoted), 1), PIECE))


def from_folders(path: Column) -> Column:
    """The text that as_folders made a path of."""
    return F.url_decode(F.regexp_replace(path, "_(/|$)", ""))


def message(action: Column, source: Column, target: Column, reason: Column) -> Column:
    """What was done to a target, for people."""
    s, t = escape_path(source), escape_path(target)
    return (
        F.when(action == HARDLINK, F.format_string("Replaced %s with hardlink to %s", t, s))
        .when(action == SYMLINK, F.format_string("Replaced %s with symlink to %s", t, s))
        .otherwise(F.format_string("skipped %s: %s", t, F.coalesce(reason, F.lit(""))))
    )
