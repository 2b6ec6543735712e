"""Delivery analytics as PySpark operators: every public function maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with their task, so nothing must be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
