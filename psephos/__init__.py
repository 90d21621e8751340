"""Analytics of contests, polls and scores on Spark DataFrames, and operations of a training-data pipeline."""

import sys

from pyspark import cloudpickle

# Executors get these functions and classes by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
