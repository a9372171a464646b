"""Dataset name to source function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from credence.sources.claims import load_pubhealth
from credence.sources.reviews import load_fakehealth
from credence.sources.snapshots import load_coaid

LOADERS = {
    "fakehealth": load_fakehealth,
    "coaid": load_coaid,
    "pubhealth": load_pubhealth,
}


def load_dataset(name: str, root, **options) -> DataFrame:
    return LOADERS[name.lower()](root, **options)
