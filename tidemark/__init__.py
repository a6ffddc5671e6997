"""A Spark-native engine for time-stamped market text and price bars."""

import sys

from pyspark import cloudpickle

# Code for executors travels by value: they need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
