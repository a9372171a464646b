"""Sources and sinks of the standard table."""

from credence.sources.registry import LOADERS, load_dataset
from credence.sources.standard import standardize
from credence.sources.tables import (
    load_processed,
    load_standardized_data,
    save_processed,
)

__all__ = [
    "LOADERS",
    "load_dataset",
    "load_processed",
    "load_standardized_data",
    "save_processed",
    "standardize",
]
