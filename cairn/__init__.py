"""Spark-native analytics over multi-source place records.

Every operator takes and returns DataFrames; plans are declarative, so Catalyst picks the physical strategy.
Python code runs on executors only as Arrow batches.
"""

import sys

from pyspark import cloudpickle

# Executors get our functions by value: the package needn't be installed on the cluster's nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
