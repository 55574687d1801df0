"""Spark jobs for daily demand panels. Functions that run inside tasks are sent by value, so executors need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
