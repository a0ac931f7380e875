"""Issue-text analytics on Spark: preparing, auditing, featurising and evaluating large corpora of issue reports."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
