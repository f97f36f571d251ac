"""H-05: strip HTML tags and non-ASCII characters, then outer whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns the cleaner removes, in order.
TAG_PATTERN = r"<[^>]+>"
NON_ASCII_PATTERN = r"[^\x00-\x7F]+"
# ASCII whitespace as Python's str.strip sees it (incl. \x1c-\x1f).
OUTER_SPACE_PATTERN = r"^[\t\n\x0b\x0c\r\x1c-\x1f ]+|[\t\n\x0b\x0c\r\x1c-\x1f ]+$"


def clean_text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, TAG_PATTERN, "")
    c = F.regexp_replace(c, NON_ASCII_PATTERN, "")
    return F.regexp_replace(c, OUTER_SPACE_PATTERN, "")
