"""Two-stage model labelling and its evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the executors by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
