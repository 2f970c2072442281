"""Column helpers for Japanese document text. Everything here stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# '.' stops only at \n (d); \d, \s, \w follow Unicode (U).
FLAGS = "(?dU)"
FLAGS_NOCASE = "(?diuU)"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\u0085  ]"
# Unicode white space and the four separators
_EDGE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "￥　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "¥ "


def rx(col: Column, pattern: str, group: int = 1, ignore_case: bool = False) -> Column:
    """First match of ``pattern``, NULL when nothing matched."""
    flags = FLAGS_NOCASE if ignore_case else FLAGS
    return F.nullif(F.regexp_extract(col, flags + pattern, group), F.lit(""))


def rx_raw(col: Column, pattern: str, group: int = 1, needs: list[str] = ()) -> Column:
    """First match or '' — for stages whose next step treats both alike.

    ``needs`` lists literals of which one must be present for the pattern to match at all; texts without any of them skip
    the pattern after a plain byte search.
    """
    found = F.regexp_extract(col, FLAGS + pattern, group)
    return F.when(has_any(col, needs), found).otherwise("") if needs else found


def has_any(col: Column, words: list[str]) -> Column:
    """Plain search for any of ``words`` as they are."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def rx_all(col: Column, pattern: str, group: int = 1, flags: str = FLAGS) -> Column:
    """Every non-overlapping match of ``pattern`` as an array."""
    return F.regexp_extract_all(col, F.lit(flags + pattern), F.lit(group))


def strip(col: Column) -> Column:
    """Remove Unicode white space on both ends."""
    return F.trim(col, F.lit(_EDGE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def normalize_text(col: Column) -> Column:
    """Full-width ASCII and digits to half width, wide yen sign and wide space too; kana stay as they are."""
    return F.when(col.rlike("[！-～￥\u3000]"), F.translate(col, _WIDE, _NARROW)).otherwise(col)


def text_lines(col: Column) -> Column:
    """Non-blank lines of a text as an array."""
    return F.filter(F.split(col, LINE_BREAK), lambda line: strip(line) != "")


def parse_amount(col: Column) -> Column:
    """``1,234`` style digits to decimal(14,2); anything unreadable is NULL."""
    return F.nullif(F.translate(col, ",，¥", ""), F.lit("")).try_cast("decimal(14,2)")  # no text is no number: a failed cast throws inside


def contains_any(lowered: Column, words: list[str]) -> Column:
    """Case-blind substring test for any of ``words``; ``lowered`` is already lower case."""
    keys = list(dict.fromkeys(w.lower() for w in words))
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in keys])


def first_group(lowered: Column, groups: list[tuple[list[str], Column]]) -> Column:
    """Value of the first group with a keyword inside ``lowered``."""
    out = None
    for words, value in groups:
        hit = contains_any(lowered, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def lookup(col: Column, table: dict, default: Column | None = None) -> Column:
    """Constant-table lookup that folds into one CASE, for tables of a few dozen fixed entries."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out if default is None else out.otherwise(default)
