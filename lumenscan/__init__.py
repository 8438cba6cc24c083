"""Spectral screening of large scan collections, expressed as Spark DataFrame transforms."""
import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
