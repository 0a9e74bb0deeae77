"""Cairnbook: a data catalog, profiling and search engine written as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run on executors travel with their code, so workers need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
