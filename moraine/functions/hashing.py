"""A 60-bit hash that Spark and DuckDB compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(salt: Column | str, value: Column) -> Column:
    """First 15 hex digits of md5('salt:value') as a non-negative bigint."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(salt.cast("string"), F.lit(":"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash60_sql(salt: str, value: str) -> str:
    """DuckDB text of ``hash60``; both arguments are SQL expressions."""
    return f"cast(('0x' || substr(md5(concat({salt}, ':', {value})), 1, 15)) as bigint)"
