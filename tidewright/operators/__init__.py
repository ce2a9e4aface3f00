"""Operators.  Functions for Python workers are pickled by value, so these need not have the package on their path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
