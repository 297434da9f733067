"""A part of a text about a question."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def around(text: Column, query: str, size: int = 2000, before: int = 300) -> Column:
    """``size`` characters from ``before`` the first place of the query's longest word (of four letters or more) that occurs; else the text's start."""
    found = sorted(set(re.findall(r"[A-Za-z_]{4,}", query.lower())), key=lambda w: (-len(w), w))
    low, out = F.lower(text), F.substring(text, 1, size)
    for w in reversed(found):
        at = F.instr(low, w)
        out = F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.lit(size))).otherwise(out)
    return out
