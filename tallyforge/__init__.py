"""Usage metering, billing rollups and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# What runs in Python workers is sent to them whole, so that executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
