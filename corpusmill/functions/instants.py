"""Points in time, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def instant(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; one without a zone is read as UTC."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp")
    return F.col(name).cast("timestamp")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(instant(df, name))
