"""Output normalisation for registered queries.

Registered queries are compared with SQL oracles by value. To keep that
comparison independent of client-side type mapping, the final projection
renders dates and timestamps as ISO text, widens integers to bigint and
rounds doubles to 6 places. The library operators themselves keep their
native types; this is only the presentation step of ``plans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FMT = "yyyy-MM-dd"
TS_FMT = "yyyy-MM-dd HH:mm:ss"
DIGITS = 6


def present(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, DATE_FMT)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_FMT)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)
