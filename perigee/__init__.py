"""Space-object analytics on Spark: catalogue, propagation, fleet health, screening."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
