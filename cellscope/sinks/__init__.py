"""Sinks: CSV results, versions that appear whole, debug dumps."""

from .csv import read_csv, versioned_path, write_csv, write_intermediates
from .versions import remove_stagings, whole_version, whole_versions

__all__ = ["read_csv", "versioned_path", "write_csv", "write_intermediates",
           "remove_stagings", "whole_version", "whole_versions"]
