"""Key-value graph analytics and record linkage on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the package's task functions with each job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
