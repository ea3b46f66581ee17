"""Text projections and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip()/str.split() treat as
# whitespace, written as a regex class that Java and RE2 both accept.
WS_CLASS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


# The same characters as a plain string, for btrim (no regex needed).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flatten_newlines(col) -> Column:
    """Every newline becomes one space; nothing else changes."""
    return F.translate(_c(col), "\n", " ")


def strip_text(col) -> Column:
    """Null -> '', strip all Unicode whitespace at both ends."""
    return F.btrim(F.coalesce(_c(col), F.lit("")), F.lit(WS_CHARS))


def cut_between_markers(col, start: str = "*** START", end: str = "*** END") -> Column:
    """Keep the text between the first and second ``start`` marker (the rest
    of the marker line stays), then everything before the first ``end``.
    A missing marker leaves the text unchanged."""
    c = _c(col)
    pos = F.instr(c, start)
    after_start = c.substr(pos + F.lit(len(start)), F.lit(2 ** 31 - 1))
    cut = F.when(pos > 0, F.substring_index(after_start, start, 1)).otherwise(c)
    return F.substring_index(cut, end, 1)


def char_tokens(col) -> Column:
    """T5: string -> array of characters (code points); '' -> []."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def whitespace_words(col) -> Column:
    """Python ``str.split()``: split on whitespace runs, no empty words."""
    c = _c(col)
    return F.array_remove(F.split(c, f"{WS_CLASS}+"), "")
