"""Render temporal columns as ISO text so results compare across engines value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATO_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
FORMATO_D = "yyyy-MM-dd"
# DuckDB spellings of the same formats.
DUCK_TS = "%Y-%m-%d %H:%M:%S.%f"
DUCK_D = "%Y-%m-%d"


def como_texto(df: DataFrame) -> DataFrame:
    """Dates -> ``yyyy-MM-dd``, timestamps -> ``yyyy-MM-dd HH:mm:ss.ffffff`` (UTC session)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), FORMATO_TS).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), FORMATO_D).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ts(col: str) -> str:
    """DuckDB expression rendering a timestamp column like ``como_texto``."""
    return f"strftime({col}, '{DUCK_TS}') AS {col.split('.')[-1]}"


def d(col: str) -> str:
    """DuckDB expression rendering a date column like ``como_texto``."""
    return f"strftime({col}, '{DUCK_D}') AS {col.split('.')[-1]}"
