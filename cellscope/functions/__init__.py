"""Scalar column expressions (all built-in Spark functions)."""

from .calendar import (call_time_range, day_bounds, enrich, parse_call_time,
                       us_week_of_year)
from .classify import hour_class

__all__ = ["call_time_range", "day_bounds", "enrich", "parse_call_time",
           "us_week_of_year", "hour_class"]
