"""Carry the fixed patterns over to the regex dialects of the JVM and of DuckDB.

The patterns are written for a dialect whose word boundary is ASCII, whose white space is
Unicode, whose dot stops at four line ends and whose ``$`` is the very end only.
"""

from __future__ import annotations

import re

SPACE_CHARS = (
    r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
SPACE = f"[{SPACE_CHARS}]"
LINE_SPACE = SPACE.replace(r"\n", "")
_DOT = r"[^\n\r\x{2028}\x{2029}]"
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _common(pattern: str) -> str:
    pattern = re.sub(r"(?<!\\)\.(?=[*+])", lambda _: _DOT, pattern)
    pattern = re.sub(r"(?<!\\)\$", lambda _: r"\z", pattern)
    return pattern.replace(r"\s", SPACE)


def _jvm_boundaries(pattern: str) -> str:
    """ASCII boundaries: in front of a word a look-behind will do, behind one a look-ahead.

    A pattern with a negative look-ahead of its own may put a boundary behind something
    else than a word; there the full form is used.
    """
    if "(?!" in pattern:
        return pattern.replace(r"\b", _BOUNDARY)
    pattern = re.sub(r"\\b(?=[\w(])", lambda _: r"(?<!\w)", pattern)
    return pattern.replace(r"\b", r"(?!\w)")


def jvm(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _common(_jvm_boundaries(pattern))


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _common(pattern)
