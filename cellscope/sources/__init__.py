"""Sources: CDR Parquet, dimension CSVs, file listings, demo mapping."""

from .cdr import exclude_files, read_cdr, read_raw_cdr, week_range
from .dims import read_adjacency, read_cells
from .files import list_files

__all__ = ["exclude_files", "read_cdr", "read_raw_cdr", "week_range",
           "read_adjacency", "read_cells", "list_files"]
