"""String expressions whose results agree with Unicode-aware regular expressions.

Java's ``\\s`` and ``\\w`` are ASCII-only by default, so the Unicode classes are spelled
out; the same spelling is valid in RE2, which keeps SQL checks identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CHARS = r"\s\x0B\x1c-\x1f\x85\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"
SPACE = f"[{SPACE_CHARS}]"


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE_CHARS}]")


def fixed_chunks(text: Column, width: int = 400) -> Column:
    """Array of consecutive ``width``-code-point pieces; empty text gives an empty array.

    One regex pass is linear in the text, whereas repeated ``substring`` restarts from the
    first byte for every piece.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def number_or(raw: Column, default: float | None) -> Column:
    """Digits and dots of ``raw`` as a double; anything unparsable gives the default."""
    digits = F.regexp_replace(raw, "[^0-9.]", "")
    parsed = digits.try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))
