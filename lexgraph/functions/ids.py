"""Deterministic identifiers from their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id(parts: list[Column], length: int = 16, separator: str = "|", prefix: str = "", sha256: bool = False) -> Column:
    """The first hex digits of SHA-1 (or SHA-256) of the parts; a null part counts as empty, never as absent."""
    joined = F.concat_ws(separator, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digest = F.sha2(joined, 256) if sha256 else F.sha1(joined)
    short = F.substring(digest, 1, length)
    return F.concat(F.lit(prefix), short) if prefix else short
