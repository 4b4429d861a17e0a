"""Analytics for tables and panels of time series, written for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Small helpers used inside pandas functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
