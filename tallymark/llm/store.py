"""Small helpers that several operators share; tables are written as in the rest of the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.tables import fresh_path, let, settle, shared_dir, temporary

__all__ = ["SPACE", "fresh_path", "let", "settle", "shared_dir", "temporary", "whole_words"]

#: ASCII white space; words are what stands between runs of it.
SPACE = r"[ \t-\r]+"


def whole_words(text: Column) -> Column:
    """The words of a text (null: none) as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
