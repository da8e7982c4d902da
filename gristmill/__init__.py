"""gristmill: grouped robust statistics, evaluation and review state on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
