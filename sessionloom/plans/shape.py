"""One form for compared results: whole numbers as long, doubles rounded, lists as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Six decimals are kept. The bound lies a little beside one half, since fractions that end
# exactly there are common and differ in their last bit between engines.
_HALF = 0.501


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            c = c.cast("int").cast("long") if isinstance(f.dataType, T.BooleanType) else c.cast("long")
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            c = F.floor(c.cast("double") * 1e6 + _HALF) / 1e6
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
        out.append(c.alias(f.name))
    return df.select(*out)


def tidy_sql(body: str, longs: str = "", doubles: str = "", texts: str = "") -> str:
    """Wrap a query so that its named columns take the same form."""
    cols = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
    cols += [f"floor(CAST({c} AS DOUBLE) * 1e6 + {_HALF}) / 1e6 AS {c}" for c in doubles.split()]
    cols += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
    return f"SELECT {', '.join(cols)} FROM ({body}) final_rows"
