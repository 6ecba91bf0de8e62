"""Run-ledger analytics: pipelines, their runs and their files as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel with the tasks that call them, so a worker
# needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
