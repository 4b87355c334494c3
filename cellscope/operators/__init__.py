"""DataFrame -> DataFrame operators."""

from .audit import audit_parquet, failed_files, oversized_ids
from .commute import cells_as_text, home_work, merge_home_work
from .hourly import hourly_cell_counts, hourly_top_cell, hourly_trajectory
from .location import residents_map, residents_per_cell, top_location
from .presence import appearance_counts, class_counts, daily_presence
from .sample import regional_records, sample_users, sampling_key, user_sample
from .spatial import spatial_appearance, spatial_stages, unique_adjacency

__all__ = [
    "audit_parquet", "failed_files", "oversized_ids",
    "cells_as_text", "home_work", "merge_home_work",
    "hourly_cell_counts", "hourly_top_cell", "hourly_trajectory",
    "residents_map", "residents_per_cell", "top_location",
    "appearance_counts", "class_counts", "daily_presence",
    "regional_records", "sample_users", "sampling_key", "user_sample",
    "spatial_appearance", "spatial_stages", "unique_adjacency",
]
