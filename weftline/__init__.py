"""Text-corpus analytics and numerical sweeps on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
