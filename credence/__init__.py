"""Credence: text-veracity analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Send the few Python functions that run in executors by value, so that the
# package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
