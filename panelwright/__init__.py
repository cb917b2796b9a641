"""Spark-first analytics over event, schedule and daily-panel data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
