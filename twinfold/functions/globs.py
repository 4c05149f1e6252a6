"""Shell globs on single names, as regular expressions for rlike.

``*`` and ``?`` don't match a slash, ``[...]`` takes ranges and ``^`` for negation, a backslash escapes, braces are
plain characters. Matches are of the whole name; leading dots need no special pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


class BadGlob(ValueError):
    pass


def _char(glob: str, at: int, of_class: bool) -> tuple[str, int]:
    """One plain character, escaped or not, and where the next begins."""
    if at >= len(glob) or (of_class and glob[at] in "-]"):
        raise BadGlob(f"invalid pattern {glob!r}")
    if glob[at] == "\\":
        at += 1
        if at >= len(glob):
            raise BadGlob(f"invalid pattern {glob!r}")
    return glob[at], at + 1


def _literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 or c == "_" else f"\\x{ord(c):02x}"


def compile_glob(glob: str) -> str:
    """A pattern for rlike and for re: anchored at both ends."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            out.append("[^/]*+" if set(glob[at:]) == {"*"} else "[^/]*")
            while at < len(glob) and glob[at] == "*":
                at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[":
            at += 1
            negated = glob[at : at + 1] == "^"
            at += negated
            ranges = []
            while not ranges or glob[at : at + 1] != "]":
                low, at = _char(glob, at, True)
                high = low
                if glob[at : at + 1] == "-":
                    high, at = _char(glob, at + 1, True)
                if low <= high:
                    ranges.append(f"{_literal(low)}-{_literal(high)}")
                else:
                    ranges.append("")
            at += 1
            kept = "".join(ranges)
            # a class of empty ranges matches nothing, its negation any character, a slash included
            out.append(f"[{'^' if negated else ''}{kept}]" if kept else (r"[\s\S]" if negated else r"[^\s\S]"))
        else:
            c, at = _char(glob, at, False)
            out.append(_literal(c))
    return "".join(out)


def validate_globs(globs: Iterable[str]) -> None:
    """Raises BadGlob at the first that is malformed."""
    for glob in globs:
        compile_glob(glob)


def any_of(globs: Iterable[str]) -> str | None:
    """One anchored pattern for all globs; a malformed one matches nothing. None if there are none."""
    parts = []
    for glob in globs:
        try:
            parts.append(compile_glob(glob))
        except BadGlob:
            continue
    return rf"(?s)\A(?:{'|'.join(parts)})\z" if parts else None


def python_pattern(globs: Iterable[str]) -> re.Pattern | None:
    pattern = any_of(globs)
    return re.compile(pattern.replace(r"\z", r"\Z")) if pattern else None
