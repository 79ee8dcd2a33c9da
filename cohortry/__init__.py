"""Prediction audit and cohort analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
