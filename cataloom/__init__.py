"""Catalogue quality, evidence checking and catalogue queries as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helper functions travel to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
