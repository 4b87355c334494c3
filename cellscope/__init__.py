"""cellscope: human-mobility analytics over call-detail records on Spark.

Plain DataFrame -> DataFrame functions built from Spark's own SQL functions,
windows and joins: home / work cells, spatial certainty, hourly trajectories,
regional user samples and an audit of unreadable input files.
"""

from . import schemas
from .functions import enrich, hour_class, parse_call_time, us_week_of_year
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _ops
from .sinks import read_csv, versioned_path, write_csv, write_intermediates
from .sources import read_adjacency, read_cdr, read_cells, read_raw_cdr

__all__ = ["schemas", "enrich", "hour_class", "parse_call_time", "us_week_of_year",
           "read_csv", "versioned_path", "write_csv", "write_intermediates",
           "read_adjacency", "read_cdr", "read_cells", "read_raw_cdr", *_ops]
