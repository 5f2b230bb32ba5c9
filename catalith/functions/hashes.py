"""Hash texts: the digits they stand for, and keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLEAN = "^[0-9a-f]{16,}$"
_RUN = "([0-9a-f]{16,})"


def hash_digits(text: Column) -> Column:
    """The hex digits a hash text stands for, in lower case; null for a null text and for one without digits.

    The digits are the first run of at least 16 hex digits (so that a prefix such as \\x, 0x or sha256: is not taken
    for digits), else all hex digits of the text. Texts that are clean already skip the search.
    """
    low = F.lower(text)
    run = F.regexp_extract(low, _RUN, 1)
    rest = F.regexp_replace(low, "[^0-9a-f]", "")
    return F.when(low.rlike(_CLEAN), low).when(run != "", run).otherwise(F.when(rest != "", rest))


def has_digits(text: Column) -> Column:
    """Whether a hash text names a hash, that is holds any hex digit; a filter on this costs little."""
    return text.rlike("[0-9A-Fa-f]")


def known_digits(text: Column) -> Column:
    """hash_digits of a text that has_digits.

    It is never null, so that filters on nulls, which joins bring too, are not pushed down into the scan, where they
    would work out the digits once more for each time the expression names them.
    """
    return F.coalesce(hash_digits(text), F.lit(""))


def known_key(text: Column) -> Column:
    """hash_key of a text that has_digits; never null, as known_digits."""
    return F.coalesce(hash_key(text), F.lit(b""))


def digits_sql(text: str) -> str:
    """hash_digits as DuckDB SQL over the expression text."""
    low = f"lower({text})"
    return (
        f"coalesce(nullif(regexp_extract({low}, '[0-9a-f]{{16,}}'), ''), "
        f"nullif(regexp_replace({low}, '[^0-9a-f]', '', 'g'), ''))"
    )


def hash_key(text: Column) -> Column:
    """A hash text as BINARY: its bytes and a last byte that is 1 for an even number of digits, 2 for an odd one.

    The last byte keeps hashes of different length apart and is never 0, so keys may be held in fixed-width arrays.
    """
    digits = hash_digits(text)
    odd = F.length(digits) % 2 == 1
    return F.when(odd, F.concat(F.unhex(F.concat(F.lit("0"), digits)), F.unhex(F.lit("02")))).otherwise(
        F.concat(F.unhex(digits), F.unhex(F.lit("01")))
    )


def binary_key(raw: Column) -> Column:
    """The key, as of hash_key, of a hash given as bytes; null for a null or empty one."""
    return F.when(F.octet_length(raw) > 0, F.concat(raw, F.unhex(F.lit("01"))))
