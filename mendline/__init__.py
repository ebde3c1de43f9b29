"""mendline: diagnosing data pipelines at scale with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
