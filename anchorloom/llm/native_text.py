"""Text statistics as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorloom.llm.common import WORD_SPLIT

SYMBOLS = "#*$%&|<>"


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def word_array(text: str = "text") -> Column:
    return F.array_remove(F.split(whole(text), WORD_SPLIT, -1), "")


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters are in the text."""
    return F.length(text) - F.length(F.translate(text, characters, ""))
