"""Python functions of this package travel to executors by value.

Executors then need NumPy, pandas and pyarrow but no copy of this package on
their own path.
"""

from __future__ import annotations

import sys


def ship_by_value() -> None:
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["vectide"])
