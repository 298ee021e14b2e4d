"""Tagloom: a PySpark-native analytics engine for tagged, blog-style text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the workers whole, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
