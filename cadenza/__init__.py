"""Cadenza: a PySpark analytics engine for music catalogues."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
