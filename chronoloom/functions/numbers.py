"""Reading numbers and words out of free text columns (JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that state that nothing is known.
UNKNOWN_WORDS = ("", "-", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "not known", "unk", "unspecified", "missing", "tbd")


def squeeze(c: Column) -> Column:
    """Without blanks at either end, of any kind."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def parse_number(c: Column, cast: Column | None = None) -> Column:
    """The number that a text states: decimal point or comma, sign, exponent, blanks and a trailing unit of microvolts are
    understood; a comma beside a point divides thousands. Null if it states none (null, empty, words, NaN, infinite). cast: c as a
    double or null, if it is a column already."""
    # The cast alone serves nearly all rows; it also reads words, type suffixes and hexadecimal numbers, which are left to the pattern.
    cast = c.try_cast("double") if cast is None else cast
    plain = F.when((F.abs(cast) < F.lit(float("inf"))) & F.right(c, F.lit(1)).between("0", "9") & (F.instr(c, "x") == 0) & (F.instr(c, "X") == 0), cast)
    bare = F.regexp_replace(squeeze(c), r"(?i)[\s\p{Z}]*[uµμ]v$", "")
    bare = F.when(F.instr(bare, ".") > 0, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    odd = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    return F.coalesce(plain, finite(odd))


def known_word(c: Column, unknown: tuple[str, ...] = UNKNOWN_WORDS) -> Column:
    """The text without outer blanks, or null where it is null, blank or a word for "unknown"."""
    word = squeeze(c)
    return F.when(~F.lower(word).isin(*unknown), word)


def is_number(kind: str) -> bool:
    """Whether a type's values are read by parse_number()."""
    return kind.split("(")[0] in ("double", "float", "decimal", "tinyint", "smallint", "int", "bigint", "long", "short", "byte")
