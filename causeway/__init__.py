"""Learning and querying discrete Bayesian networks over large tables with Spark."""

import sys

from pyspark import cloudpickle

# Group functions travel to the executors by value, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
