"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so a cluster need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
