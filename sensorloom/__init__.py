"""Spark-native analytics for sensor and measurement tables.

The package is registered to be shipped by value, so functions that run on
executors need no installation there beyond the third-party libraries they use.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
