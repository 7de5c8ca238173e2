"""Dataset descriptors and readers."""

from .catalog import default_datasets
from .csv import load_dataset, load_datasets, with_row_id
from .spec import DatasetSpec

__all__ = ["DatasetSpec", "default_datasets", "load_dataset", "load_datasets", "with_row_id"]
