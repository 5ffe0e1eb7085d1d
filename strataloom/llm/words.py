"""Words and terms of texts: only A-Z are lower-cased, everything beyond ASCII belongs to a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words of ASCII letters and digits, and of other characters, in lower or upper case.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_array(text: Column, between: str = BETWEEN_WORDS) -> Column:
    """The words of a text, A-Z lower-cased; null and texts without a word give an empty array.

    Texts of ASCII alone are lower-cased as a whole, others word by word, where few words have other characters.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = F.when(F.octet_length(text) == F.length(text), F.split(F.lower(text), between)).otherwise(F.transform(F.split(text, between), _lower))
    return F.array_remove(parts, "")


def byte_table(digits: bool) -> bytes:
    """For ``bytes.translate`` on UTF-8: A-Z to a-z; all of ASCII but letters, and digits if asked for, to a space."""
    kept = lambda c: c > 0x7F or chr(c).isalpha() or (digits and chr(c).isdigit())
    return bytes(ord(chr(c).lower()) if c < 0x80 and kept(c) else c if c > 0x7F else 0x20 for c in range(256))
