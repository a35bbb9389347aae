"""Evidence retrieval, fusion, gating and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
