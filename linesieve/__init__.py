"""linesieve: exact and approximate deduplication of lines and records on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for executors travel by value, so that a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
