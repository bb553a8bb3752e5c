"""Unicode text helpers as native column expressions.

Spark's own ``trim``, ``\\s`` and ``lower`` follow narrower rules than full
Unicode text handling does: ``trim`` removes U+0020 only, ``\\s`` is ASCII and
``lower`` is not a case fold.  Everything that compares or cuts text in this
package goes through the helpers below.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column, functions as F

# The characters that count as white space, and those that end a line.
WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
WHITESPACE_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNEVEN = f"[{WHITESPACE_CLASS}&&[^ ]]|  "
_ROUGH = rf"^ | \z|{_UNEVEN}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Text) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(col(c), F.lit(WHITESPACE_CHARS))


def is_blank(c: Text) -> Column:
    """Nothing but white space; looks no further than the first other character, and at a printable ASCII one without a pattern."""
    c = col(c)
    return F.when((c >= F.lit("!")) & (c < F.lit("\x7f")), F.lit(False)).otherwise(~c.rlike(f"[^{WHITESPACE_CLASS}]"))


def words(c: Text) -> Column:
    """Split on runs of white space; no empty words."""
    parts = F.split(strip(c), f"[{WHITESPACE_CLASS}]+")
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(parts)


def lines(c: Text) -> Column:
    """Split into lines; a final line end does not open another line."""
    c = col(c)
    body = F.regexp_replace(c, f"(?:{LINE_END})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Lower-case characters whose case fold differs, taken from the Unicode data."""
    chars = [c for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c != c.casefold()]
    singles = [c for c in chars if len(c.casefold()) == 1]
    expansions = {c: c.casefold() for c in chars if len(c.casefold()) > 1}
    return "".join(singles), "".join(c.casefold() for c in singles), expansions


def casefold(c: Text) -> Column:
    """Full Unicode case folding: ``lower`` plus the characters it leaves alone."""
    before, after, expansions = _fold_table()
    c = col(c)
    lowered = F.translate(F.lower(c), before, after)
    pairs = F.split(F.lit("|".join(f"{a}={b}" for a, b in expansions.items())), r"\|")
    expanded = F.aggregate(
        pairs,
        lowered,
        lambda text, pair: F.replace(text, F.substring_index(pair, "=", 1), F.substring_index(pair, "=", -1)),
    )
    # Cheap tests first: ASCII needs no table, and ``translate`` finds characters faster than a pattern.
    special = F.translate(lowered, "".join(expansions), "") != lowered
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).when(special, expanded).otherwise(lowered)


def normalize(c: Text) -> Column:
    """Identity form of a text: white space collapsed, case folded."""
    even = bind(strip(c), lambda text: F.when(text.rlike(_UNEVEN), _collapse(text)).otherwise(text))
    return bind(even, casefold)


def normalize_column(c: Text) -> Column:
    """``normalize`` of what costs nothing to read again: words between single blanks, and letters that fold to one letter, need no lambda."""
    c = col(c)
    return F.when(c.rlike(_ROUGH), normalize(c)).otherwise(casefold(c))


def _collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITESPACE_CLASS}]+", " ")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def unrolled(values: Column, size: int, body, general: Column) -> Column:
    """``body`` of the elements of an array that has ``size`` of them, as generated code; ``general``, for any size, otherwise.

    Functions with a lambda are interpreted, element by element.
    """
    return F.when(F.size(values) == size, body([F.get(values, F.lit(i)) for i in range(size)])).otherwise(general)


def first_index(haystack: Text, needle: Text) -> Column:
    """Zero-based position of the first occurrence, -1 if there is none."""
    return F.position(col(needle), col(haystack)) - 1


def window_before(c: Text, index: Column, width: int) -> Column:
    """At most ``width`` characters in front of a zero-based index."""
    start = F.greatest(index - width, F.lit(0))
    return F.substring(col(c), start + 1, index - start)


def window_around(c: Text, index: Column, length: Column, width: int) -> Column:
    """The match at ``index`` with up to ``width`` characters on both sides."""
    c = col(c)
    start = F.greatest(index - width, F.lit(0))
    end = F.least(F.length(c), index + length + width)
    return F.substring(c, start + 1, end - start)


def contains_any(c: Text, needles) -> Column:
    """True if one of the literal needles occurs."""
    c = col(c)
    found = F.lit(False)
    for needle in needles:
        found = found | c.contains(needle)
    return found


def count_matches(c: Text, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def compute(df, name: str, value: Column):
    """Add a costly column so that later filters and columns read it instead of repeating it.

    A generator is a barrier that predicates are not pushed through.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
