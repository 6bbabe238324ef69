"""The token rule: a run of Unicode letters, digits and underscores, or any other single non-blank character."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of Python's ``\s``, spelt out for Java, whose ``\s`` is ASCII.
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
JAVA_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]"
TOKEN = re.compile(r"\w+|[^\w\s]")


def token_count(text: Column) -> Column:
    """The number of tokens of ``text``, counted in the JVM; null of a null."""
    return F.regexp_count(text, F.lit(JAVA_TOKEN))
