"""Text expressions: lines and white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines without their ends: a last line feed opens no line, one carriage return before it goes too; empty text has none."""
    body = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    whole = F.split(body, "\n")
    lines = F.when(text.contains("\r"), F.transform(whole, lambda x: F.regexp_replace(x, r"\r\z", ""))).otherwise(whole)
    return F.when(text.isNull() | (text == ""), F.expr("cast(array() as array<string>)")).otherwise(lines)


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    spaceless = F.trim(x)  # the common case; a pattern only where other white space is left
    return F.when(spaceless.rlike(r"(?U)^\s|\s\z"), F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")).otherwise(spaceless)


def strip_start(x: Column) -> Column:
    spaceless = F.ltrim(x)
    return F.when(spaceless.rlike(r"(?U)^\s"), F.regexp_replace(x, r"(?U)^\s+", "")).otherwise(spaceless)
