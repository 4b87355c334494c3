"""Home / work hour class of a call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

# Night hours are before 05:00 or from 21:00 on.
HOME_BEFORE = 5
HOME_FROM = 21


def hour_class(hour: Column | str = S.HOUR_OF_DAY) -> Column:
    """``HOME_HOUR`` for hours 0-4 and 21-23, ``WORK_HOUR`` for 5-20 and the
    empty string for a missing hour. A native CASE, so a filter on the class
    is visible to the optimizer (unlike an opaque UDF)."""
    h = F.col(hour) if isinstance(hour, str) else hour
    return (F.when(h.isNull(), F.lit(S.NO_HOUR))
             .when((h < HOME_BEFORE) | (h >= HOME_FROM), F.lit(S.HOME_HOUR))
             .otherwise(F.lit(S.WORK_HOUR)))
