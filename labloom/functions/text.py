"""Text expressions used all over the engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Full-width ASCII, the spaces that aren't U+0020, and letters of other scripts drawn like Latin ones.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_SPACES = "           　\t"
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_ALIKE = ("АВЕКМНОРСТХІЅаеорсухіѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορ", "ABEKMHOPCTXISaeopcyxisABEZHIKMNOPTYXvop")


def ascii_forms(c: Column) -> Column:
    """Full-width forms, odd spaces, invisible characters and look-alike letters as plain ASCII; for matching, not for display."""
    wide = "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(c, _WIDE + _SPACES + _ALIKE[0] + _INVISIBLE, wide + " " * len(_SPACES) + _ALIKE[1])


def one_spaced(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """Lower case, trimmed, '' for null."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
