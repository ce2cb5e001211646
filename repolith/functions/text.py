"""Text in the order that people expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def locale_order(text: Column | str) -> Column:
    """A key that sorts by the root collation: letters first, then accents, then case, small before capital. Add the text itself for a total order."""
    return F.collate(F.col(text) if isinstance(text, str) else text, "UNICODE")
