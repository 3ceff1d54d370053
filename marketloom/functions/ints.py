"""Integer arithmetic on nanosecond times, which doubles cannot hold exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(column: Column | str, n: int) -> Column:
    """Floor of column / n in integers, right for negative values too."""
    x = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))
