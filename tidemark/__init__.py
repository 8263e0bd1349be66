"""A PySpark analytics engine for tagged time series and training-data preparation."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code with them, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
