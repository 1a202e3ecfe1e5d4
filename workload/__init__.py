"""The registered queries: the operators bound to the driver's tables."""

import importlib
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = (
    "text_queries",
    "label_queries",
    "evaluation_queries",
    "comparison_queries",
    "page_queries",
    "source_queries",
    "stream_queries",
    "landed_queries",
)


def load():
    """Import every query module and return the registry they filled."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
