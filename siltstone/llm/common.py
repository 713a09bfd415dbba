"""Small helpers shared by the operators on files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(raw: bytes | None) -> str:
    """Text of a file: byte-order mark dropped, line feeds only, Latin-1 where it isn't UTF-8."""
    if not raw:
        return ""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def clean_path(c: Column) -> Column:
    """Forward slashes, no leading './' or '/'."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\\+", "/"), r"^(\./+|/+)+", "")
