"""Spark-native text, graph and change analytics."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors do not need
# this package on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
