"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a blank is the Unicode White_Space set plus the four ASCII separators 1C-1F.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
LINKS = r"(?U)(?:http|www)[^\s\x1c-\x1f]+"


def clean_text(text: Column) -> Column:
    """Lower case, links removed up to the next blank, runs of blanks made one space, ends trimmed. NULL stays NULL."""
    without_links = F.regexp_replace(F.lower(text), LINKS, "")
    return F.trim(F.regexp_replace(without_links, BLANKS, " "))
