"""Fathomline: hybrid search and document analytics as plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so it needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
