"""quirefold: document layout, sectioning and corpus preparation on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
