"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Python code that runs on executors is
pickled by value, so executors need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
